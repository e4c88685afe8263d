"""Template residue, filler and error pages in place of content.

A text is first cut into what readers see as prose and what is code: fenced and indented blocks, code
spans, quoted phrases and lines of program text are set aside, because syntax and messages are in their
right place there. Placeholders are then found by one grammar per kind of delimiter, and discounted in
sentences that explain them; filler by the density of filler words and set phrases; error, block and script
notices by sentences that say nothing else, and by status lines at the head of a text in whatever language.

Every rule names letters or signs without which it can't match. A text is asked for those first, so a rule
runs only on the lines that hold one of its signs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

SHORT_TEXT = 600  #: a text of fewer characters may be a page of which any line tells the status

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]")
_FENCE = re.compile(r"(?ms)^[ \t>]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)")
_SPAN = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_QUOTE = re.compile(r"\"[^\"\n]{1,160}\"|“[^”\n]{1,160}”|„[^“”\n]{1,160}[“”]|«[^»\n]{1,160}»|(?<!\w)'[^'\n]{3,160}'(?!\w)")
_CODE_LINE = re.compile(
    r"^\s*(?:(?:pub|fn|let|use|impl|struct|enum|mod|match|if|for|while|return|const|static|type|trait|unsafe|async|def|class|import|from|export|var|function|select|insert|update|create|echo|curl|cargo|git|npm|run|env|script|steps?|with|value|key|name|image|command|args?)\b[^.?]*[:={}();\[$]|[{}()\[\];,]+\s*$|\$\s|>>>\s|#\[|@\w+\(|\w+!\(|[\w.\-]+\s*[:=]\s*[\"'\[{$]|-\s+[\w.\-]+:\s|[A-Z_]+=|\w+\()"
    r"|[;{}]\s*$|=>|::\w+\(|\bformat!\(|\bprintln!\(|\bwrite!\("
)
# Words of the usual filler text.
_FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum libero congue mattis varius rutrum posuere pretium vestibulum pellentesque nullam vitae".split())
_LATIN_SIGNS = ("lorem", "ipsum", "dolor", "consectetur", "adipiscing", "eiusmod", "incididunt", "aliqua", "veniam", "nostrud", "ullamco", "laboris", "commodo", "voluptate", "pariatur", "cupidatat", "deserunt", "vestibulum", "pellentesque")
_WORD = re.compile(r"[^\W\d_]+")

_NAMES = r"[A-Za-z_][\w.\- ]{0,40}"
# One grammar for each kind of delimiter.
PLACEHOLDERS = {
    "braces": re.compile(r"(?<![$\\{])\{\{[-~#/^&!>]?\s*[A-Za-z_][^{}\n]{0,60}\}\}"),
    "block": re.compile(r"\{%-?\s*\w[^%\n]{0,80}-?%\}"),
    "dollar": re.compile(r"\$\{\s*[A-Za-z_][\w.\-]{0,40}\s*\}"),
    "tag": re.compile(r"<%[=\-#]?\s*[\w@][^%\n]{0,60}%>"),
    "hash": re.compile(r"#\{\s*[A-Za-z_@][\w.\-]{0,40}\s*\}"),
    "percent": re.compile(r"%%[A-Za-z_][\w\-]{1,40}%%|(?<![\w%])%[A-Z][A-Z_]{2,40}%(?![\w%])|%\([a-z_]\w{0,40}\)[sd]"),
    "at": re.compile(r"@@[A-Za-z_][\w\-]{1,40}@@|(?<!\w)@[A-Z][A-Z_]{2,40}@(?!\w)"),
    "dollars": re.compile(r"\$\$[A-Za-z_][\w\-]{1,40}\$\$"),
    "angles": re.compile(r"<<\s*[A-Za-z_][\w.\- ]{1,40}\s*>>(?!\w)"),
    "squares": re.compile(r"\[\[\s*[A-Za-z_][\w.\-]{1,40}\s*\]\](?!\()"),
    "under": re.compile(r"(?<!\w)__[A-Z][A-Z_]{2,40}__(?!\w)"),
    "curly": re.compile(r"(?<![\w${\\#%/(])\{[a-z]+(?:_[a-z]+){0,4}\}(?![}\w/(])"),
    "insert": re.compile(r"(?i)[\[<(]\s*(?:(?:please\s+)?(?:insert|enter|add|fill in|replace|put|type)\s+(?:\w+\s*){0,5}|your[ _\-](?:\w+[ _\-]?){1,4}|(?:\w+\s+){1,3}(?:goes\s+)?here|(?:hier|bitte|ihr|ihre|ihren|dein|deine|votre|vos|su|sus|tu|il tuo|la tua|il vostro|seu|sua|uw|ваш|ваше|ваша)\s[^\]>\n]{2,40}|(?:insérer|insérez|ins[ée]rez|compléter)\s[^\]>\n]{2,40}|(?:insertar|inserte|escriba)\s[^\]>\n]{2,40}|(?:company|project|product|author|first|last|full|customer|user)[ _\-]?name|todo|tbd|xxx+)\s*[\]>)](?!\()"),
    "mask": re.compile(r"(?<![\w.])(?:XX[./\-]XX[./\-]XXXX|XXXX[./\-]XX[./\-]XX|YYYY[./\-]MM[./\-]DD|DD[./\-]MM[./\-]YYYY|TT[./]MM[./]JJJJ|JJ/MM/AAAA)(?![\w])"),
    "format": re.compile(r"(?<![\w%\"'])%[sd](?=[ ,.!?:;)]|$)"),
    "rendered": re.compile(r"\[object Object\]|\bInvalid Date\b|\b(?:Hello|Hi|Dear|Hallo|Bonjour|Hola|Welcome)\s+(?:undefined|NaN|null)\b|\b(?:of|in|by|have)\s+(?:undefined|NaN)\b"),
    "position": re.compile(r"(?<![\w${\\])\{\d\}(?![}\w])"),
    "capitals": re.compile(r"\[(?:YOUR |THE |INSERT )?(?:[A-Z]+ ){0,2}(?:DATE|NAME|TITLE|AUTHOR|OWNER|YEAR|VERSION|EMAIL|E-MAIL|URL|LINK|ADDRESS|COMPANY|PROJECT|PRODUCT|DESCRIPTION|SUMMARY|TEXT|CONTENT|PLACEHOLDER|DATUM|FECHA|NOM|NOMBRE)\](?!\()"),
}
#: Delimited placeholders and failed renderings, which say nothing about whether their line is code.
_FIELD = re.compile("|".join(PLACEHOLDERS[k].pattern for k in ("braces", "block", "dollar", "tag", "hash", "percent", "at", "dollars", "angles", "squares")) + r"|\[object Object\]|\[[A-Z][A-Z ]{2,30}\]|\[[^\W\d_][\w'’]*(?: [\w'’]+)+\]|(?<![\w$])\{(?:[a-z_]+|\d)\}")
_KEY_ONLY = re.compile(r"^\s*(?:#+\s*)?[a-z]\w*(?:\.[a-z]\w*){2,6}\s*$")

_FILLERS = re.compile(
    r"(?ix)^[\s#*>\-]*(?:\w[^.!?\n]{0,40}:\s*)? (?: (?:tbd|tba|todo|t\.b\.d\.|fixme|xxx+|n/a\ yet|coming\ soon|to\ be\ (?:written|done|completed|added|defined|announced|filled\ in)(?:\ (?:soon|later))?|more\ to\ come)"
    r"| (?:sample|section|example|dummy|body|placeholder|default|your|some|insert|add|paragraph|intro|description|summary)\ (?:text|content|paragraph|copy|title|heading|description)(?:\ (?:goes|comes|belongs|will\ go|here)(?:\ here)?)?"
    r"| (?:your|the|this|add|write|put|insert|enter|type|place|page|main)\ (?:\w+\ ){0,3}(?:goes?|comes?|belongs?|text|content|description|summary|introduction)?\ ?(?:here)"
    r"| (?:replace|edit|delete|remove|change|overwrite|fill\ in|rewrite)\ (?:this|the|me)\b(?:\ (?:placeholder|paragraph|text|section|sentence|line|block|sample|example|content|template|dummy|page|description|part)(?:\ (?:before|with|by|when|once|and|prior|later|here)\b.*)?|)"
    r"| (?:this\ (?:is\ (?:a|just\ a|only\ a)\ )?)?placeholder(?:\ (?:for|text|content|paragraph|copy|page|image)\b.*)? | this\ (?:page|section|document|text|paragraph)\ (?:is|was|has\ been)?\ ?(?:intentionally\ left\ blank|(?:still\ )?(?:to\ be|needs\ to\ be|must\ be|has\ yet\ to\ be)\ (?:written|filled|completed|added).*|is\ (?:still\ )?empty|is\ a\ (?:stub|placeholder|template|draft).*)"
    r"| (?:der\ |hier\ )?(?:text|inhalt|beschreibung|beispieltext|blindtext|platzhalter|mustertext|titel|einleitung|abschnitt)(?:\ (?:folgt|kommt|fehlt|einf[üu]gen|hier|noch|wird|steht|ersetzen|eintragen|erg[äa]nzen|für|fuer)\b.*)? | hier\ (?:steht|kommt|folgt|text|inhalt)\b.* | (?:bitte|noch)\ (?:ausf[üu]llen|erg[äa]nzen|ersetzen|einf[üu]gen|auszuf[üu]llen)\b.* | (?:diesen|dieser)\ (?:text|absatz|abschnitt)\b.*(?:ersetzen|l[öo]schen|[üu]berschreiben).*"
    r"| (?:description|texte|contenu|titre|section|introduction|r[ée]sum[ée]|paragraphe)\ (?:[àa]\ (?:compl[ée]ter|venir|r[ée]diger|remplacer|ins[ée]rer|remplir)|d['’]exemple|factice|provisoire|ici).* | (?:votre|ins[ée]rez|ins[ée]rer|[ée]crivez|ajoutez|saisissez|remplacez)\ .{0,40}\ ?(?:ici|texte|contenu|paragraphe)\b.* | [àa]\ (?:compl[ée]ter|venir|remplir|d[ée]finir)"
    r"| (?:texto|contenido|descripci[óo]n|t[íi]tulo|resumen|introducci[óo]n|secci[óo]n|p[áa]rrafo)\ (?:de\ (?:ejemplo|relleno|muestra|prueba)|pendiente|por\ (?:completar|definir|escribir|rellenar)|aqu[íi]|provisional).* | (?:su|tu|escriba|inserte|a[ñn]ada|agregue|introduzca|reemplace|sustituya)\ .{0,40}\ ?(?:aqu[íi]|texto|contenido|p[áa]rrafo)\b.* | por\ (?:completar|definir|rellenar) | pendiente\ de\ (?:completar|redactar|escribir).*"
    r"| (?:describe|explain|summari[sz]e|introduce|state|outline|write|give|list|mention|add|tell)\ (?:the|this|your|what|how|why|who|which|a|an|one|here)\b.{0,60}\b(?:in|with)\ (?:a\ few|one|two|three|one\ or\ two|two\ or\ three|\d)\ (?:short\ )?(?:sentences?|words?|lines?|paragraphs?|bullets?)"
    r"| (?:add|write|insert|provide|give|put|include|enter)\ (?:a|an|some|your|the)\ (?:(?:short|brief|one-line|one-sentence|longer|detailed|clear)\ )?(?:description|summary|overview|explanation|introduction|abstract|paragraph|sentence|example)(?:\ (?:of|about|for|on)\ (?:what|why|how|this|the|your)\b.{0,50}|\ here)?"
    r"| (?:beschreib\w*|erkl[äa]r\w*|d[ée]crivez|d[ée]crire|expliquez|describa|describe|explique|resuma)\b.{0,60}\b(?:in\ (?:ein|zwei|wenigen)|en\ (?:une|deux|quelques|una|dos|pocas))\b.{0,20}\b(?:s[äa]tz\w*|wort\w*|phrases?|mots|frases?|palabras|l[íi]neas)"
    r"| (?:(?:list\ )?item|bullet|point|step|feature|heading|column|punkt|eintrag|[ée]l[ée]ment|punto|elemento)\ (?:one|two|three|four|[1-4]|eins|zwei|drei|un|deux|trois|uno|dos|tres) )[\s.!…*_]*$"
)

_CODE = r"(?:4\d\d|5\d\d)"
_STATUS = r"(?:not found|page not found|bad request|unauthorized|forbidden|access denied|access forbidden|request timeout|conflict|gone|too many requests|internal server error|internal error|server error|bad gateway|service (?:temporarily )?unavailable|temporarily unavailable|gateway time-?out|proxy error|sign-in required|login required|authentication required|permission denied|down for maintenance|under maintenance|maintenance|seite nicht gefunden|nicht gefunden|zugriff verweigert|interner (?:server)?fehler|page introuvable|accès refusé|erreur (?:interne )?du serveur|página no encontrada|acceso denegado|error (?:interno )?del servidor|nothing here|payment required|method not allowed|connection (?:refused|timed out)|request blocked|site offline|rate limit(?:ed| exceeded)|quota exceeded|pagina non trovata|accesso negato|errore (?:interno )?del server|página não encontrada|acesso negado|erro (?:interno )?do servidor|pagina niet gevonden|toegang geweigerd|страница не найдена|доступ (?:запрещ[её]н|закрыт)|ошибка сервера|strona nie (?:została znaleziona|istnieje)|nie znaleziono strony|sayfa bulunamadı|sidan (?:hittades inte|kunde inte hittas)|siden (?:blev|ble) ikke (?:fundet|funnet)|sivua ei löy(?:dy|tynyt)|stránka (?:nenalezena|nebyla nalezena)|az oldal nem található|pagina nu a fost găsită|η σελίδα δεν βρέθηκε|сторінку не знайдено|halaman tidak ditemukan|không tìm thấy trang)"
_ERRORS = re.compile(
    rf"(?ix)^[\s#*>\-=|]*(?:<h\d>\s*)?(?:oops|sorry|whoops|uh-?oh|hoppla|ups|désolé|lo\ sentimos)?[\s!.,:\-–—]*(?:"
    rf"(?:HTTP/\d(?:\.\d)?\s+)?(?:error|fehler|erreur|status|code|http)?[\s:#]*{_CODE}(?:[\s:\-–—.|()]*(?:{_STATUS.replace(' ', chr(92) + ' ')}))?(?:\s*error)?"
    rf"|(?:error|fehler|erreur)?[\s:]*(?:{_STATUS.replace(' ', chr(92) + ' ')})(?:[\s:\-–—|]*\(?(?:error\ |http\ )?{_CODE}\)?)?"
    rf")\s*(?:</h\d>)?\s*(?:[.!…]|$|<|\s+(?=(?:try|the|you|your|we|something|please|sign|log|wait|this|it|reload|back|planned|nginx|ray|error\ id|reference|thank)\b))"
)
_NOTICE = re.compile(
    "|".join((
        # pages that are not there
        r"^(?:sorry,? )?(?:the|this|that) (?:page|address|site|resource|document|file|url|link|content)(?: that)? (?:you (?:asked for|requested|are looking for|were looking for|tried to (?:open|reach))|(?:at )?this address)?\s?(?:was moved|was not found|could not be found|cannot be found|can't be found|does not exist|doesn't exist|no longer exists|never existed|has (?:been )?(?:moved|removed|expired)|is (?:gone|not available|unavailable|no longer available|temporarily unavailable|missing|offline|down))",
        r"^we (?:could|can)(?:not|n't| not) (?:find|locate) (?:that|the|this) (?:page|address|resource|site|url)",
        r"^the link (?:may|might) be (?:broken|outdated|wrong)",
        r"^(?:die|diese) (?:angeforderte |gesuchte |gewünschte )?(?:seite|adresse) (?:wurde nicht gefunden|existiert nicht|konnte nicht gefunden werden|ist (?:nicht|leider nicht|derzeit nicht|vorübergehend nicht) (?:verfügbar|erreichbar|vorhanden))",
        r"^(?:seite nicht gefunden|zugriff verweigert|dienst nicht verfügbar|zu viele anfragen|anmeldung erforderlich|wartungsarbeiten|wartungsmodus|ein (?:interner |unerwarteter )?fehler ist aufgetreten|interner (?:server)?fehler|bitte (?:später erneut versuchen|versuchen sie es später|laden sie die seite neu))\b",
        r"^(?:der|die|unser|unsere|diese) (?:server|dienst|seite|website|webseite)\b.{0,30}\b(?:nicht (?:erreichbar|verfügbar)|gewartet|überlastet|wartung)",
        r"^(?:page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|service (?:indisponible|temporairement indisponible)|trop de requêtes|connexion requise|site en maintenance|maintenance en cours|erreur (?:interne|serveur|inattendue|du serveur)|une erreur (?:interne |inattendue )?(?:est survenue|s'est produite)|veuillez (?:vous connecter|réessayer|patienter|recharger|activer)|réessayez plus tard)\b",
        r"^(?:la|cette) page (?:demandée |que vous (?:cherchez|demandez) )?(?:n'existe (?:pas|plus)|est introuvable|n'a pas été trouvée|n'est pas disponible|a été (?:déplacée|supprimée))",
        r"^(?:página no encontrada|acceso (?:denegado|prohibido)|servicio no disponible|demasiadas (?:solicitudes|peticiones)|sitio en mantenimiento|en mantenimiento|error (?:interno|del servidor|inesperado)|se (?:ha producido|produjo) un error|ha ocurrido un error|inicie sesión para|inténtelo (?:de nuevo )?más tarde|intente (?:de nuevo )?más tarde|vuelva a intentarlo)\b",
        r"^la página (?:solicitada |que busca )?(?:no existe|no está disponible|no se (?:encuentra|encontró)|ha sido (?:movida|eliminada))",
        r"^el enlace puede estar roto",
        # servers that did not answer
        r"^(?:something went wrong|an? (?:unexpected |internal |unknown )?error (?:has )?occurred|the (?:server|service|upstream|request|connection|website|site)(?: \w+)? (?:could not|cannot|can't|did not|failed to|gave no|took too long|is (?:temporarily|currently|down|unavailable|overloaded|under|not)|timed out|was (?:reset|refused|blocked|rejected)|encountered)|we(?: wi|')ll be back|we are (?:currently )?(?:down|offline|performing)|we(?:'re| are) (?:sorry|working on|having trouble)|planned work is under way|scheduled maintenance|this (?:site|service|page|website) is (?:currently |temporarily )?(?:down|offline|unavailable|under (?:maintenance|construction))|(?:please )?try again (?:later|in a (?:few|moment|minute))|(?:please )?(?:come|check) back (?:later|soon)|thank you for your patience)",
        # callers that are not let in
        r"^(?:your (?:address|ip|account|browser|request|connection|session|network) (?:is not allowed|is blocked|has been (?:blocked|flagged|denied|suspended)|was (?:blocked|denied)|has expired|expired|is not supported|looks unusual)|you (?:are not|aren't|do not|don't|have been|need permission|must be|need to be|must) (?:authorized|authorised|allowed|have (?:access|permission)|blocked|banned|signed|logged|sign|log|denied)|you have (?:hit|reached|exceeded) (?:the|your) (?:rate|request|daily|usage)? ?limit|(?:please )?(?:sign|log) in (?:with|to|again|first)\b|wait a (?:minute|moment|few)|access (?:to this (?:page|site|resource) )?(?:is |has been |was )?(?:denied|forbidden|restricted|blocked))",
        r"^(?:verify|confirm|prove|check) (?:that )?(?:you are|you're) (?:a )?(?:human|not a robot)|^(?:are you|i am|i'm) (?:a|not a) (?:robot|human)|^checking (?:your|the) (?:browser|connection|if)|^(?:please )?(?:complete|solve) the (?:captcha|challenge|security check)|^(?:verifying|please verify) (?:that )?you are|^(?:unusual|suspicious) (?:traffic|activity)|^(?:ray|incident|request) id[: ]",
        r"^we use cookies\b|^this (?:site|website|page) uses cookies|^accept (?:all )?(?:cookies|all or)|^(?:wir verwenden|diese (?:seite|website) verwendet) cookies|^(?:nous utilisons|ce site utilise) des cookies|^(?:utilizamos|usamos|este sitio (?:usa|utiliza)) cookies",
        r"^(?:we(?:'ve| have)? |our systems? (?:have )?)?(?:noticed|detected|seen|registered) (?:some )?(?:unusual|suspicious|automated|abnormal) (?:traffic|activity|requests?)|^(?:please )?solve (?:the|this|a) (?:puzzle|captcha|challenge|task)\b|^(?:wir haben|nous avons|hemos) .{0,30}(?:ungewöhnlich|verdächtig|inhabituel|suspect|inusual|sospechos)\w*",
        r"^(?:your |the |this )?(?:request|access|connection|account|session) (?:is |was |has been )?(?:temporarily |currently )?(?:blocked|denied|refused|rejected|suspended)\b[^.;:,]{0,30}[.!]?$",
        r"^(?:you (?:are|will be) (?:being |now )?)?redirect(?:ing|ed)(?: you| now| to \S+| to the \w+ page)?\s*[.!…]*$|^(?:please )?(?:click|press|tap|follow) (?:here|this link|the link)\b.{0,20}\bif\b.{0,60}|^if you are not (?:sent on|redirected|forwarded)|^(?:sie werden|du wirst) (?:automatisch |gleich )?weitergeleitet|^weiterleitung\b[^.:;]{0,20}[.!…]?$|^(?:vous (?:allez être|êtes|serez)|redirection (?:en cours|vers))\b.{0,20}(?:redirigé|cours|vers)|^(?:redirigiendo|será redirigid|serás redirigid|está siendo redirigid)",
        # scripts that are needed
        r"^(?:please |you (?:need|have) to |you must |to (?:view|use|continue)[^.]{0,40},? (?:please )?)?(?:enable|activate|turn on|switch on|allow) (?:javascript|scripts?|scripting)\b",
        r"^(?:javascript|scripts?|scripting|js) (?:is|are|must be|needs? to be|appears? to be|seems? to be) (?:required|disabled|needed|turned off|switched off|not enabled|off|blocked|enabled|necessary|not available|not supported)",
        r"^(?:this|the|our) (?:site|page|app|application|viewer|website|documentation|form|service)\b.{0,30}\b(?:needs?|requires?|relies on|depends on|does not work without|doesn't work without|will not work without|won't work without|stays empty without|cannot (?:start|run|load) without)\b.{0,20}\b(?:javascript|scripts?|scripting)\b",
        r"^(?:<noscript>)?\s*without (?:javascript|scripts?|scripting)\b|.*<noscript>|^(?:your browser|the browser|it looks like|it seems)\b.{0,40}\b(?:javascript|scripts?|scripting|them)\b.{0,20}(?:disabled|off|switched off|blocked|not enabled|turned off)",
        r"^your browser (?:has (?:them|it|javascript|scripts) (?:switched|turned) off|does not (?:run|support|allow)|is (?:too old|not supported|outdated))",
        r"^(?:bitte )?(?:aktivieren|aktiviere|schalten) (?:sie )?(?:bitte )?.{0,20}(?:javascript|skripte?)\b|^(?:javascript|skripte?) (?:ist|sind|muss|müssen|wird|werden)\b|^(?:diese|die) (?:seite|website|anwendung|dokumentation)\b.{0,30}\b(?:benötigt|braucht|erfordert|funktioniert nicht ohne)\b.{0,20}\b(?:javascript|skripte?)",
        r"^(?:veuillez )?(?:activez|activer|autorisez) .{0,20}(?:javascript|scripts?)\b|^(?:cette|la|ce) (?:page|site|application|documentation)\b.{0,30}\b(?:nécessite|requiert|a besoin de|exige)\b.{0,20}\b(?:javascript|scripts?)|^javascript (?:est|doit être)\b",
        r"^(?:por favor,? )?(?:active|activa|habilite|habilita|permita) .{0,20}(?:javascript|scripts?)\b|^(?:esta|la|este) (?:página|sitio|aplicación|documentación)\b.{0,30}\b(?:necesita|requiere|precisa)\b.{0,20}\b(?:javascript|scripts?)|^javascript (?:es|está|debe)\b|^se requiere javascript",
        r"^we(?:'|’)?(?:ll| will| are|re) (?:be )?(?:right |soon )?back\b|^(?:be )?right back\b|^back (?:soon|shortly|in a (?:few|bit|moment|minute))\b|^(?:we are|we(?:'|’)re) (?:making|doing|carrying out) (?:some )?(?:changes|improvements|upgrades|updates|repairs|maintenance)\b",
        r"^(?:ページが見つかりません|お探しのページ|このページは(?:存在しません|見つかりません)|アクセスが拒否されました|ただいまメンテナンス中|メンテナンス中|页面(?:未找到|不存在)|找不到(?:该|此)?(?:页面|网页)|您(?:访问|请求)的页面|頁面(?:不存在|未找到)|拒绝访问|系统维护|페이지를 찾을 수 없|요청하신 페이지|접근이 거부|الصفحة غير موجودة|لم يتم العثور على الصفحة)",
        r"^if nothing happens,? (?:reload|refresh)|^(?:turn|switch) (?:it|them) on and (?:refresh|reload)|^<div id=.(?:root|app|__next).></div>$",
    )),
    re.I,
)
# Beginnings of words for switching on and for needing, in the languages of the web.
_SWITCH_ON = "enabl|activ|aktiv|turn on|switch on|allow|habilit|permit|attiv|abilit|ative|inschakel|schakel|включ|włącz|etkinleştir|有効|启用|啟用|활성화|povol|zapn|engedélyez|ενεργοπ|увімкн|kích hoạt|تفعيل"
_NEED = "need|requir|necess|depend|benötig|brauch|erforder|nécess|requi|besoin|exige|neces|precis|richied|requer|nodig|vereist|необход|требу|нужен|wymag|gerek|krävs|kræv|krev|必要|需要|필요|vyžad|szüks|απαιτ|потріб|cần|يتطلب"
_SCRIPTED = re.compile(rf"(?i)^(?=[^.!?。]*(?:java ?script|skript))(?=[^.!?。]*(?:{_SWITCH_ON}|{_NEED}))")
_SCRIPT_TALK = re.compile(r"(?i)\b(?:we|our|crawler|parser|files?|module|code|function|library|written|build|bundle|tests?|typescript|version|release|compiler?|lexer|engine)\b")
_STATUS_LINE = re.compile(r"^[\s#*>=|\-]*(?:<h\d>\s*)?(?:[^\W\d_]{2,12}[\s:#\-]+)?(?:4(?:0\d|1\d|2[1-9]|31|51)|5(?:0\d|1[01]|2\d|30))(?:\s*[-–—:|·,.]+\s*[^\W\d_]|\s(?=[^.]{2,40}$)(?![a-zß-ÿ])[^\W\d_])[^\n.!?;:(){}=]{2,60}[.!]?\s*(?:</h\d>)?\s*$")
_TUTORIAL = re.compile(r"(?i)\b(?:templates?|placeholders?|syntax|tags?|variables?|fields?|render\w*|replac\w+|expands?|expression|braces|brackets|delimiters?|escap\w+|interpolat\w+|vorlagen?|platzhalter|ersetzt|modèles?|balises?|remplac\w+|plantillas?|reemplaz\w+|works?|prints?|writes?)\b")

#: Signs of each grammar, in lower case: a text without them needs no look at it.
_GRAMMAR_SIGNS = {
    "braces": ("{{",), "block": ("{%",), "dollar": ("${",), "tag": ("<%",), "hash": ("#{",), "percent": ("%",), "at": ("@",), "dollars": ("$$",), "angles": ("<<",), "squares": ("[[",), "under": ("__",), "curly": ("{",),
    "insert": ("[", "<", "("), "mask": ("xx", "yyyy", "dd", "tt.", "tt/", "jj/"), "format": ("%s", "%d"), "rendered": ("[object", "invalid date", "undefined", "nan", "null"), "position": ("{0", "{1", "{2", "{3", "{4", "{5", "{6", "{7", "{8", "{9"), "capitals": ("[",),
}
_BRACKETED = re.compile(r"[\[<(]\s*[\w'’ \-]{2,60}\s*[\]>)]")
#: Signs of which every notice has one, in lower case.
_NOTICE_SIGNS = tuple(
    "moved|found|exist|remov|expired|gone|available|unavailable|missing|offline|is down|not find|n't find|not locate|n't locate|link may be|link might be|nicht gefunden|existiert nicht|verfügbar|erreichbar|vorhanden|verweigert|anfragen|anmeldung|wartung|fehler|erneut|später|seite neu|gewartet|überlastet"
    "|introuvable|non trouvée|refusé|interdit|indisponible|requêtes|connexion|maintenance|erreur|veuillez|réessayez|n'existe|été trouvée|disponible|déplacée|supprimée|no encontrada|denegado|prohibido|solicitudes|peticiones|mantenimiento|error interno|error del|error inesp|un error|sesión|más tarde|vuelva a|no existe|no está|no se enc|movida|eliminada|enlace puede"
    "|went wrong|occurred|could not|cannot|can't|did not|failed to|gave no|too long|temporarily|currently|overloaded|is under|timed out|was reset|was refused|was blocked|was rejected|encountered|be back|back soon|back shortly|back in a|right back|back later|we are|we're|we’re|having trouble|planned work|scheduled|construction|try again|patience"
    "|your address|your ip|your account|your browser|your request|your connection|your session|your network|you are|you're|you aren't|you do not|you don't|you have|you need|you must|sign in|log in|wait a|denied|forbidden|restricted|blocked|human|robot|the browser|checking|captcha|challenge|security check|verify|unusual|suspicious|ray id|incident id|request id"
    "|noticed|detected|registered|puzzle|ungewöhnlich|verdächtig|inhabituel|suspect|inusual|sospechos|suspended|redirect|sent on|forwarded|if you are not|weitergeleitet|weiterleitung|redirig|redirection|here if|link if|cookie|accept all|script|skript|switched off|turned off|not enabled|disabled|too old|not supported|outdated|nothing happens|turn it|switch it|turn them|switch them|<div id|is not|ページ|アクセス|メンテナンス|页面|网页|拒绝|系统维护|頁面|페이지|접근|الصفحة".split("|")
)
_STATUS_NUMBER = re.compile(_CODE)
#: Signs of an error line: a word of each status.
_STATUS_SIGNS = tuple(dict.fromkeys(max(re.split(r"[^\w -]+", w), key=len).strip(" -") for w in re.sub(r"\(\?:[^()]*\)\??", "|", _STATUS[3:-1]).split("|") if len(w) > 3))
#: Signs of filler phrases.
_FILLER_SIGNS = tuple("tbd|tba|todo|t.b.d|fixme|xxx|n/a yet|coming soon|to be |more to come| text| content| paragraph| copy| title| heading| description|here|replace|edit|delete|remove|change|overwrite|fill in|rewrite|placeholder|this page|this section|this document|this text|this paragraph|inhalt|beschreibung|blindtext|platzhalter|mustertext|beispieltext|text folgt|titel|einleitung|abschnitt|hier |ausf|ergänz|ergaenz|erg\u00e4nz|ersetz|einf|diesen|dieser|contenu|titre|section à|introduction|résumé|resume|paragraphe|factice|provisoire|ici|à compl|à venir|à rempl|à déf|a compl|a venir|contenido|descripci|título|titulo|resumen|introducci|secci|párrafo|parrafo|aquí|aqui|por comp|por def|por rell|pendiente|texto|sentence|words|lines|bullets|sätz|satz|phrase|mots|frase|palabras|item |bullet |point |step |feature |heading |column |punkt |eintrag |élément |punto |elemento ".split("|"))
_SPLIT = re.compile(r"(?<=[.!?…。])\s+")
_SPLIT_TAGS = re.compile(r"(?<=[.!?…。])\s+|(?<=</h\d>)\s*|(?<=>)\s*(?=<)")


_LINE, _STATUS_BIT, _NOTICE_BIT, _FILLER_BIT, _LATIN_BIT = 1, 2, 4, 8, 16
_KINDS = tuple(_GRAMMAR_SIGNS)


@lru_cache(maxsize=1)
def _signs():
    """One automaton of all signs, with a bit for what each is a sign of; line ends are told too."""
    bits: dict[str, int] = {"\n": _LINE}
    for bit, words in ((_STATUS_BIT, _STATUS_SIGNS), (_NOTICE_BIT, _NOTICE_SIGNS), (_FILLER_BIT, _FILLER_SIGNS), (_LATIN_BIT, _LATIN_SIGNS)):
        for word in words:
            bits[word] = bits.get(word, 0) | bit
    for number, kind in enumerate(_KINDS):
        for word in _GRAMMAR_SIGNS[kind]:
            bits[word] = bits.get(word, 0) | 32 << number
    automaton = ahocorasick.Automaton()
    for word, bit in bits.items():
        automaton.add_word(word, bit)
    automaton.make_automaton()
    return automaton


def _marked(text: str) -> tuple[dict[int, int], int]:
    """Bits of the signs of each line that has any, and of all lines together."""
    out: dict[int, int] = {}
    line = whole = 0
    for _, bits in _signs().iter(text.lower()):
        if bits & 1:
            line += 1
        else:
            out[line] = out.get(line, 0) | bits
            whole |= bits
    return out, whole


def _visible(text: str) -> str:
    """Without characters that show nothing and without fenced code; line ends are newlines."""
    text = _INVISIBLE.sub("", text) if not text.isascii() else text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text


def _shown(line: str) -> str | None:
    """A line as readers see it; None when it is blank or program text."""
    if line.startswith(("    ", "\t")) and line.strip() and not line.lstrip().startswith(("-", "*")):
        return None
    line = _MARKUP.sub("", line)
    if not line.strip() or _CODE_LINE.search(_FIELD.sub("x", line) if _MARKS.search(line) else line):
        return None
    return line


_MARKUP = re.compile(r"^\s*(?:///?!?|//!|\*(?!\*)|>)\s?")
_MARKS = re.compile(r"[{}%$#@<\[]|__[A-Z]|XX|YYYY|MM")


def prose(text: str) -> list[str]:
    """Lines shown to readers as prose, with code blocks and code lines cut out."""
    return [shown for line in _visible(text).split("\n") if (shown := _shown(line)) is not None]


def filler_density(lines: list[str], window: int = 12) -> float:
    """Largest share of filler words in any ``window`` words in a row."""
    flags = [w.lower() in _FILLER for line in lines for w in _WORD.findall(line)]
    if len(flags) < 2:
        return 0.0
    run = sum(flags[:window])
    best = run
    for a, b in zip(flags, flags[window:]):
        run += b - a
        best = max(best, run)
    return best / min(window, len(flags))


def _placeholders(line: str, grammars: list[str]) -> set[str]:
    """Kinds of unfilled placeholders in a line of prose, those of sentences that explain them left out."""
    bare = _SPAN.sub(" ", line) if "`" in line else line
    unquoted = _QUOTE.sub(" ", bare)
    found = {kind: PLACEHOLDERS[kind].findall(bare if kind in ("format", "rendered") else unquoted) for kind in grammars if kind not in ("insert", "capitals") or "[" in unquoted or _BRACKETED.search(unquoted)}
    found = {kind: hits for kind, hits in found.items() if hits}
    if found and len(set(map(str.lower, _TUTORIAL.findall(_FIELD.sub(" ", unquoted))))) > 1 and 4 * sum(map(len, found.values())) < len(_WORD.findall(unquoted)):
        return set()
    return set(found)


def _sentences(line: str) -> list[str]:
    return (_SPLIT_TAGS if "<" in line else _SPLIT).split(line.strip())


def _is_notice(sentence: str) -> bool:
    return _NOTICE.match(sentence) is not None or len(sentence) < 160 and _SCRIPTED.match(sentence) is not None and not _SCRIPT_TALK.search(sentence)


def reasons(text: str | None) -> list[str]:
    """Why a text is residue; empty for content. Null and empty texts are no residue."""
    if not text or not text.strip():
        return []
    text = _visible(text)
    marked, whole = _marked(text)
    numbered = _STATUS_NUMBER.search(text) is not None
    found: set[str] = set()
    if whole & _LATIN_BIT and filler_density(prose(text)) >= 0.75:
        found.add("filler")
    head, short = True, len(text) < SHORT_TEXT
    for number, line in enumerate(text.split("\n")):
        if not line or line.isspace():
            continue
        first, head = head or short, False
        bits = marked.get(number, 0)
        if numbered and not bits & _STATUS_BIT and _STATUS_NUMBER.search(line):
            bits |= _STATUS_BIT
        dotted = line.count(".") > 1 and _KEY_ONLY.match(line) is not None
        if not bits & ~_LATIN_BIT and not dotted:
            continue
        told = None
        if bits & (_STATUS_BIT | _NOTICE_BIT | _FILLER_BIT):
            # what a sentence would say, before it is asked whether readers see it as prose
            told = [t for t in (x.strip(" \t*_|") for x in _sentences(_MARKUP.sub("", line))) if t]
            told = any(bits & _FILLER_BIT and len(t) < 200 and _FILLERS.match(t) or bits & _STATUS_BIT and _ERRORS.match(t) or bits & _NOTICE_BIT and _is_notice(t) for t in told) or first and bits & _STATUS_BIT or '"' in line or "`" in line or "<" in line
        if not told and bits < 32 and not dotted:
            continue
        shown = _shown(line)
        if shown is None:
            continue
        if bits >= 32:
            found |= {f"placeholder:{kind}" for kind in _placeholders(shown, [k for i, k in enumerate(_KINDS) if bits & 32 << i])}
        if dotted and _KEY_ONLY.match(shown):
            found.add("placeholder:key")
        if first and bits & _STATUS_BIT and _STATUS_LINE.match(shown):
            found.add("error")
        if not told:
            continue
        bare = _SPAN.sub(" ", shown) if "`" in shown else shown
        bare = _QUOTE.sub(" Q ", bare) if not bare.lstrip().startswith("<") else bare
        for sentence in _sentences(bare):
            sentence = sentence.strip(" \t*_|")
            if not sentence:
                continue
            if bits & _FILLER_BIT and len(sentence) < 200 and _FILLERS.match(sentence):
                found.add("filler:phrase")
            if bits & _STATUS_BIT and _ERRORS.match(sentence):
                found.add("error")
            elif bits & _NOTICE_BIT and _is_notice(sentence):
                found.add("notice")
    return sorted(found)


def flag(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and reasons of the documents to leave out.

    Null ids, null and empty texts give no rows; repeated rows count once; an empty table gives none.
    """
    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text")).filter("doc_id is not null and text is not null")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["reasons"] = [reasons(t) for t in batch.pop("text")]
            yield batch[batch["reasons"].str.len() > 0]

    # repeats are dropped from what was found: the texts themselves never pass a shuffle
    return rows.mapInPandas(judge, "doc_id long, reasons array<string>").distinct()


def residue_documents(documents: DataFrame) -> DataFrame:
    return flag(documents).select("doc_id").distinct()


def without_residue(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``documents`` without the flagged ones; all columns stay, rows with a null id are kept."""
    flagged = flag(documents, id_column).select("doc_id").distinct().withColumnRenamed("doc_id", "__flagged")
    return documents.join(flagged, documents[id_column] == flagged["__flagged"], "left_anti")
