"""Given names, their case forms by rule, and transliteration."""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

# Given names, Russian.
MALE = """
александр алексей анатолий андрей антон аркадий арсений артём артур богдан борис борислав бронислав вадим валентин
валерий василий виктор виталий владимир владислав всеволод вячеслав геннадий георгий герман глеб григорий давид даниил
демьян денис дмитрий евгений егор елисей ефим захар иван игнат игорь илья иннокентий ипполит кирилл клим константин
кузьма лев леонид лука макар максим марат марк мартын матвей мирон михаил назар никита николай олег осип остап павел
пётр платон прохор радий ренат роберт родион роман ростислав руслан савва савелий самуил святослав семён сергей
станислав степан тарас тимофей тимур тихон трофим фёдор филипп фома эдуард эльдар эмиль эрик юлиан юрий яков ян ярослав
""".split()
FEMALE = """
агата аглая аделина алевтина александра алина алиса алла алёна альбина амина анастасия ангелина анна антонина
анфиса арина ася белла берта богдана валентина валерия варвара василиса вера вероника виктория виолетта галина дарина
дарья диана дина евгения евдокия екатерина елена елизавета ева жанна зинаида злата зоя инга инесса инна ирина карина
кира клавдия клара кристина ксения лада лариса лидия лилия лина любовь людмила майя маргарита марина мария марта
милана милена мирослава надежда наталия наталья нелли ника нина нонна оксана олеся ольга полина раиса регина римма роза
руслана светлана серафима снежана софия софья стефания таисия тамара татьяна ульяна фаина юлиана юлия эвелина элеонора
эльвира эмилия эмма яна ярина ярослава
""".split()
# Given names in Latin letters beside the transliterated Russian ones.
LATIN = """
aaron adam adrian agnes alan albert alfred alice amelia amy andrew anna anne ansel anthony arthur audrey barbara basil
beatrice benjamin bernard bridget briony bruce caroline caspar catherine cecil charles charlotte christopher clara
claire colin conrad corwin cyril daniel david deborah delphine diana donald dorothy douglas duncan edgar edith edmund
edward edwin eleanor elizabeth ella ellen emily emma eric ernest ethel eugene evelyn felix fergal fiona florence frances
francis frederick gareth geoffrey george gerald gilbert gordon gregory gwen halden hannah harold harriet harry helen
henry herbert howard hugh ian ingrid irene isaac isabel jack jacob james jane janet jasper jean jennifer jessica joan
john jonathan joseph joyce judith julia juniper karen kate katherine keith kenneth laura lawrence leonard lewis lilian
louis louise lucy luke marcus margaret maria marion marla martha martin mary matthew maurice michael miriam monica muriel
nancy nathan neil nicholas nigel noel nora norman odette oliver olivia oscar oswald owen pamela patricia patrick paul
peter philip phoebe rachel ralph raymond rebecca renée richard robert roger ronald rosalind rupert ruth samuel sarah
sheila sidney simon sophia stephen stuart susan sylvia theodore thomas timothy tobin ursula victor vincent violet walter
wendy wilfred william winifred zoe zoë
""".split()
# Latin letters for Cyrillic ones, as passports write them.
_TRANSLIT = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh sch  y  e yu ya e".split(" ")))


def translit(word: str) -> str:
    return "".join(_TRANSLIT.get(c, c) for c in word)


def forms(name: str) -> set[str]:
    """The case forms of a Russian given name, by its ending."""
    stem = name[:-1]
    if name.endswith("я"):
        out = {stem + e for e in ("я", "и", "е", "ю", "ей")}
    elif name.endswith("а"):
        out = {stem + e for e in ("а", "ы", "и", "е", "у", "ой", "ей")}
    elif name[-1] in "йь":
        out = {name} | {stem + e for e in ("я", "ю", "ем", "е", "и", "ью")}
    else:
        out = {name + e for e in ("", "а", "у", "ом", "е")}
    out |= {"павел": {"павла", "павлу", "павлом", "павле"}, "лев": {"льва", "льву", "львом"}, "пётр": {"петра", "петру", "петром", "петре"}}.get(name, set())
    return out | {x.replace("ё", "е") for x in out}


def cases(word: str) -> list[str]:
    """The genitive, dative, accusative, instrumental and prepositional of a word of a Russian name, by its ending."""
    low = word.lower()
    if not low or not "\u0400" <= low[0] <= "\u04ff" or len(low) < 3:
        return []
    stem, two = word[:-1], word[:-2]
    if low.endswith(("ова", "ева", "ёва", "ина", "ына")):
        ends = [stem + e for e in ("ой", "у")]
    elif low.endswith("ая"):
        ends = [two + e for e in ("ой", "ую")]
    elif low.endswith(("ий", "ый", "ой")):
        ends = [two + e for e in ("ого", "ому", "им", "ым", "ом")]
    elif low.endswith(("ов", "ев", "ёв", "ин", "ын")):
        ends = [word + e for e in ("а", "у", "ым", "е")]
    elif low.endswith("ия"):
        ends = [stem + e for e in ("и", "ю", "ей")]
    elif low.endswith(("а", "я")):
        soft = low[-1] == "я"
        ends = [stem + e for e in (("и", "е", "ю", "ей") if soft else ("ы", "и", "е", "у", "ой", "ей"))]
    elif low.endswith(("й", "ь")):
        ends = [stem + e for e in ("я", "ю", "ем", "е")]
    elif low[-1] in "бвгджзклмнпрстфхцчшщ":
        ends = [word + e for e in ("а", "у", "ом", "ем", "е")]
    else:
        ends = []
    return ends


def declined(name: str) -> list[str]:
    """A name of up to three words in other cases, each word in each of its forms."""
    parts = name.split()
    forms_of = [[p, *cases(p)] for p in parts]
    if not parts or len(parts) > 3:
        return []
    out = [" ".join(x) for x in itertools.islice(itertools.product(*forms_of), 1, 512)]
    return list(dict.fromkeys(out))


@lru_cache(1)
def russian_forms() -> frozenset[str]:
    """All case forms of the Russian given names."""
    return frozenset(f for n in MALE + FEMALE for f in forms(n))


@lru_cache(1)
def latin_names() -> frozenset[str]:
    """Given names in Latin letters, the Russian ones as passports write them."""
    return frozenset(LATIN) | {translit(n) for n in MALE + FEMALE} | {translit(n).replace("iy", "y") for n in MALE + FEMALE}


# Greedy reading of Latin letters as Cyrillic, longest first.
_BACK = {"shch": "щ", "sch": "щ", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "yu": "ю", "ya": "я", "yo": "ё"} | dict(zip("abvgdezijklmnoprstufhcyx", "абвгдезийклмнопрстуфхкыкс"))


def to_cyrillic(word: str) -> str:
    word = word.lower()
    out, i = "", 0
    while i < len(word):
        n = next((n for n in (4, 3, 2, 1) if word[i : i + n] in _BACK), 0)
        out += _BACK.get(word[i : i + n], word[i]) if n else word[i]
        i += n or 1
    return out


SURNAME = re.compile(r"(?:[оеё]в|[иы]н|[сц]кий|[сц]кой|[оеё]ва|[иы]на|[сц]кая|ец|[иы]х|ко|[аую]к|ян|дзе|швили|ев[аоуы]|ов[аоуы]м?|ин[аоуы]м?|евой|овой|иной|ского|скому|ским|ской|скую)$")
PATRONYMIC = re.compile(r"^[а-яё]{2,}(?:ович|евич|ич)(?:а|у|ем|е)?$|^[а-яё]{2,}(?:овн|евн|ичн|иничн)(?:а|ы|е|у|ой)$")
