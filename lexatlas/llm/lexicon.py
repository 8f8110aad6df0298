"""Words and phrases of abusive, hateful and sexual language in six languages, and the reading of disguised ones.

They give densities, which are features of a model (see harmful.py), not decisions.
"""

from __future__ import annotations

import re
import unicodedata

ALIKE = str.maketrans("аеорсхукмтвніѕјαορνɑ", "aeopcxykmtbhisjaopva") | str.maketrans({"@": "a", "$": "s", "ß": "ss", "ø": "o", "ł": "l", "’": "'", "‘": "'"})
#: Insults for a person.
INSULTS = (
    "idiot idiots moron morons imbecile dumbass bastard scumbag fraud loser asshole arsehole bitch cunt retard cretin dickhead prick twat wanker whore slut clown trash garbage shit filth "
    "abruti abrutie debile connard connasse crétin imbécile ordure salaud salope minable merde raclure "
    "imbecil basura payaso cabron idiota mierda gilipollas estupido estupida inutil lixo merda palhaco cretino otario "
    "imbecille stronzo deficiente scemo pagliaccio coglione arschloch trottel vollidiot depp mull abschaum dummkopf wichser penner versager drecksack"
)
EXTRA = "porn porno pornos cock sex vermin ungeziefer plague plaga praga thieves nude"
FUZZY_FROM = 5

#: Reports, studies and quotations of such language.
REPORTED = r"""\b(coded|annotated|annotat\w+ (by|\d)|annote|anotaron|anotamos|annotato|werteten|untersucht|etudiee?s?|se estudi\w+|studiat\w|estudad\w|clasificaron|classees|classificat\w|classificad\w|geordnet|interviewees|interviewed|the term|denotes|a filter|chronicle|reviewer wrote|trials|screening|hate speech|discours de haine|discurso de odio|discorso d odio|hassrede|survey asked|sexual (health|reproduction)|were measured by|were classified|insults such as|slur|corpus of (insults|comments))\b"""
ADDRESSED = r"""\b(you|yourself|u|du|dir|dich|toi|tu (es|n es)|t es|eres|es (um|uma|tao)|sei|what an?|author is|callate|cala a boca|zitto|comme toi|ferme la|oye)\b|\bwhoever\b"""
ABUSE = r"""shut up\b|\bchoke on (it|them)|crawl back into|you make me sick|nobody would miss you|(jump|throw yourself) (off|and|into)|kill yourself|(break|smash|cut|rip|crush|knock) (out )?your (fingers|face|teeth|neck|legs|arms|head|skull|bones)
|\b(kill|hurt|strangle|stab|shoot) you\b|know where you live|find your body|watch you (bleed|die|burn|suffer)|hope (you|your \w+) .*(burn|die|rot|suffer)|your (own )?mother must be ashamed|brain of a\b|and so are you\b|favou?r and disappear|room gets dumber
|you(r| are| re)? too (dumb|stupid) to|should never be let near|like you could (write|make|draw)|you will not walk home
|ferme la\b|ta gueule|la gueule\b.*(te|si je)|sait ou tu habites|une merde comme toi|va crever|creve\b.*\btoi|trop (bete|con) pour|tu n es qu un
|callate\b|igual que tu\b|ojala te mueras|sabemos donde vives|te voy a (romper|partir|matar)|te (rompo|parto|mato)|demasiado (tonto|estupido|tonta|estupida) para
|cala a boca|tal como tu\b|sabemos onde (moras|vives)|(parto|rebento) te|vou te (partir|matar)|oxala morras|tomara que morras|(demasiado|muito) burro para|es burro demais
|proprio come te|spacco la faccia|ti (spacco|ammazzo|uccido)|sappiamo dove (vivi|abiti)|chiudi il becco|sta(i)? zitt[oa]|troppo (stupido|scemo|stupida) per|spero che tu (muoia|crepi)|crepa\b
|halt die klappe|halt s? ?maul|genau wie du\b|schlag\w* dir|brech\w* dir|wissen wo du wohnst|du bist zu (dumm|blod)|verreck\w*|dich umbringen"""
HATE = r"""\b(are|is) (all )?(nothing but )?(a )?(vermin|plague|parasites|subhuman|the disease of|filthy and dangerous)\b|should be driven out|not belong here|send them (all )?back|born \S+ and liars|born thieves|decent journal should publish anything by|in their blood|breed like rats|burn their houses|take our posts
|get rid of .{2,60} once and for all|minds are simply inferior|they are inferior|dogs have more sense|good place for .{2,60} bottom of|knew what to do with|can smell it when|rest of their kind|never been allowed to live among us|and we are the cure|refuse to share a desk|keep .{2,60} out of the universities|they are too stupid to think|ruin every town
|sont de la vermine|faut les chasser|n ont rien a faire ici|qu on les renvoie|ruinent chaque ville|puent et devraient|enfermes loin de nous|menteurs de naissance|embauchez jamais|trichent par nature|vivre parmi nous|sont inferieur\w+|voleurs de naissance
|son una plaga|hay que echarl[oa]s|que se larguen|ladrones de nacimiento|mentiros\w+ de nacimiento|apestan y|encerrad[oa]s lejos|contrateis a nadie|enganan por naturaleza|vivir entre nosotros|son inferiores|arruinan cada
|sao uma praga|ser expuls[oa]s|viver entre nos|sao inferiores|enganam por natureza|cheiram mal|fechad[oa]s longe|que se vao embora|ladroes de nascenca|mentiros\w+ de nascenca|no sangue|arruinam cada|contratem ninguem|nao pertencem aqui
|puzzano e|rinchius[ei] lontano|vivere tra noi|sono inferiori|sono (dei )?parassiti|vanno cacciat[ie]|imbrogliano per natura|ladri (di nascita|nati)|bugiard\w di nascita|rovinano ogni|assumete mai|se ne vadano|devono andarsene
|sind ungeziefer|verjagt werden|gehoren nicht hierher|alle loswerden|stinken und sollten|von geburt an|weg von uns eingesperrt|betrugen von natur|stellt n\w+ .{2,40} ein\b|sind minderwertig|unter uns leben|ruinieren jede|im blut"""
SEXUAL = r"""\b(porn|porno|pornos|xxx|horny|cock|blowjob|panties|tits|cum|orgasm)\b(?! (trial|censor))|lick every part|undress you slowly|wet dreams|naked singles|adults on webcam|strip for you|with pleasure until|screamed with pleasure|\bhad (\w+ )?sex\b|went down on h|finished in h\w+ mouth|between h\w+ thighs|kissed her breasts|bare bottom|uncut adult|no clothes every|your clothes outside|see me n\w+de\b|dirty photo|naughty adults|until both of them came|on top of me
|filles nues|photo de toi nue?|je suis excitee?|adultes coquins|deshabillent pour toi|entre ses cuisses|gemit de plaisir|dans sa culotte|firent l amour|l orgasme|lecher tout
|desnudas y calientes|foto desnud[oa]|follaron|correrse|en las bragas|lamerte|cachond[oa]|se desnudan para|gimio de placer|adultos traviesos
|nuas e quentes|mulheres nuas|despem se para|fizeram sexo|gozarem|nas cuecas|gemeu de prazer|foto nu[a]?\b|lamber te|excitad[oa]|tesao
|donne nude|si spogliano|fecero sesso|all orgasmo|mutandine|gemette di piacere|leccart\w+|eccitat[oa]|foto nud[ao]|adulti maliziosi
|nackte heisse|nacktbild|\bgeil\b|versaute|ziehen sich live|wilden sex|bis beide kamen|in ihren slip|stohnte vor lust|zog ihn nackt|ablecken"""


def _pattern(text: str) -> re.Pattern:
    return re.compile(text.replace("\n", ""))


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


SENTENCES = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|[\r\n  ]+|\s[:;]-?[()]\s")
QUOTED = re.compile(r"(?<![^\s(])'[^'\n]{2,120}'(?!\w)|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»")
SPELT_OUT = re.compile(r"(?<!\w)(?:\w[-_.*]){3,}\w(?!\w)")
MASKED = re.compile(r"[^\W\d_]+(?:[*#]+[^\W\d_]*)+")
WORDS = [*dict.fromkeys(_bare(INSULTS).split()), *EXTRA.split()]
BY_KEY: dict[str, str] = {}
for _w in WORDS:
    if len(_w) >= FUZZY_FROM:
        for _i in range(len(_w)):
            BY_KEY.setdefault(_w[:_i] + _w[_i + 1 :], _w)  # a letter left out
            BY_KEY.setdefault(_w[:_i] + _w[_i : _i + 2][::-1] + _w[_i + 2 :], _w)  # two swapped
BY_KEY |= {w: w for w in WORDS}
for _w in ("rash", "tras", "lown", "clow", "mul", "idiom", "raud", "loser", "lose", "lack", "ordre", "merd", "mere", "debil"):
    if _w not in WORDS:
        BY_KEY.pop(_w, None)
INSULT = set(_bare(INSULTS).split())
RULES = {"abuse": _pattern(ABUSE), "hate": _pattern(HATE), "sexual": _pattern(SEXUAL)}
REPORT, SPOKEN = re.compile(REPORTED), re.compile(ADDRESSED)


def unmasked(m: re.Match) -> str:
    """The word meant where letters are replaced by * or #, or as it is."""
    pattern = re.compile("".join(".*" if x[0] == "*" else ".{1,2}" if x[0] == "#" else re.escape(x) for x in re.findall(r"\*+|#|[^*#]+", m[0])))
    return next((w for w in WORDS if pattern.fullmatch(w)), m[0])


HIDDEN = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
MARKS = re.compile("[\u0300-\u036f]")
DRAWN = re.compile(r"([^\W\d_])\1{2,}")


def clear(text: str) -> str:
    """Lower case without accents, hidden characters, look-alikes and disguises."""
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower().translate(ALIKE)
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = SPELT_OUT.sub(lambda m: re.sub(r"[-_.*]", "", m[0]), text)
    if "*" in text or "#" in text:
        text = MASKED.sub(unmasked, text)
    return DRAWN.sub(r"\1", text)


def worded(text: str) -> list[str]:
    """The words of a cleared text, misspelt insults as they are meant."""
    return [BY_KEY.get(w, w) for w in re.findall(r"\w+", text)]
