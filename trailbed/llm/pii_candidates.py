"""High-recall generators of spans that may be personal information, and the features that describe them.

Every generator is guarded by a mark that each of its matches holds, so a text without the mark is passed by and none
that the generator would match is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

KINDS = ("email", "phone", "idnum", "address", "person")


class Span(NamedTuple):
    kind: int
    begin: int
    end: int
    form: int  # which generator proposed it


class Lexicon(NamedTuple):
    """Helps given from outside: given names, and ranks of words in a public vocabulary, in lower case and capitalised."""

    given: frozenset[str]
    ranks: dict[str, tuple[float, float]]


def _ranges(test) -> str:
    """A character class of the letters of the Latin, Greek and Cyrillic scripts that pass a test."""
    out, begin = [], None
    for i in [*range(0x41, 0x530), 0x1E00 - 1, *range(0x1E00, 0x1F00), 0x1F00]:
        on = i not in (0x1DFF, 0x1F00) and chr(i).isalpha() and test(chr(i))
        if on and begin is None:
            begin = last = i
        elif on and i == last + 1:
            last = i
        elif begin is not None:
            out.append(chr(begin) if begin == last else f"{chr(begin)}-{chr(last)}")
            begin = i if on else None
            last = i
    return "".join(out)


# E-mail addresses, also spelled out.
_L = "A-Za-zÀ-ɏ0-9_"  # word characters of the Latin script: signs of others may touch an item
_LOCAL = rf"[{_L}+%-]+(?:'[{_L}+%-]+)*"
_AT = r"(?: ?[\[({<] ?(?:at|ät|arroba|chez|@) ?[\])}>] ?|(?-i: AT )| (?:at|ät|arroba|chez) (?=[\w-]+ [\[({]?(?:dot|punkt|punto|point)\b))"
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|punkt|punto|point|点|\.) ?[\])}>] ?| (?:dot|punkt|punto|point) )"
EMAIL = re.compile(rf"(?<![{_L}.+%-]){_LOCAL}(?:\.{_LOCAL})*@[{_L}-]+(?:\.[{_L}-]+)+")
SPELLED_MARK = re.compile(_AT, re.I)
EMAIL_SPELLED = re.compile(rf"(?<![{_L}.+%-]){_LOCAL}(?:{_DOT}{_LOCAL})*{_AT}[{_L}-]+(?:{_DOT}[{_L}-]+)*", re.I)

# Runs of groups of digits; E.164 allows at most 15 digits.
PHONE = re.compile(rf"(?<![{_L}.+\-/#])(?<!\d:)(?:\+\d{{1,3}}|\(\+?\d{{1,4}}\)|\d+)(?:[ .\-/]{{0,2}}(?:\(\d{{1,4}}\)|\d+))*(?![{_L}])")
_GROUP = re.compile(r"\(?\+?\d+\)?")

# State-issued numbers by their usual shapes.
ID_START = re.compile(rf"(?<![{_L}.\-/+])(?=[A-Z]{{0,6}}[- ]?\d(?:[A-Z .+-]?\d){{3}})")
IDS = tuple(
    re.compile(rf"(?<![{_L}.\-/+]){p}(?![{_L}]|[-./]\d)")
    for p in (
        r"\d{3}([- ])\d{2}\1\d{4}",  # social security and taxpayer numbers
        r"\d{17}[\dXx]", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\d{2} ?\d{3} ?\d{3} ?\d{3}", r"\d{8}[- ]?[A-Z]", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]",
        r"\d{4}([- ]?)\d{4}\1\d{4}", r"[A-Z]{1,3} ?\d{6,9}", r"\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}", r"[XYZ][- ]?\d{7}[- ]?[A-Z]", r"[A-Z]{5}\d{4}[A-Z]", r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]",
        r"\d{6}-\d{7}", r"\d{6,8}[-+]\d{4}", r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?", r"\d{3}([- ]?)\d{3}\1\d{3}", r"\d{11}",
    )
)

_UP = f"[{_ranges(str.isupper)}]"
_LETTER = f"[{_ranges(lambda c: True)}0-9_]"
_CAP = rf"{_UP}(?:{_LETTER}|['’](?={_LETTER}))*(?:-{_UP}{_LETTER}*)*"
_SMALL = r"(?:de|del|de la|de los|van|von|der|den|van der|van den|von der|di|da|dos|do|du|des|la|le|bin|ibn|al|el|y|ten|ter|zu)"
_US_WAY = r"(?:St\.?|Street|Ave\.?|Avenue|Blvd\.?|Boulevard|Dr\.?|Drive|Rd\.?|Road|Ln\.?|Lane|Ct\.?|Court|Way|Place|Pl\.?|Terrace|Parkway|Pkwy|Square|Sq\.?|Mews|Close|Crescent|Gardens|Row|Hill|Walk|Grove|Circle|Cir\.?|Highway|Hwy|Trail|Loop|Alley)"
_CITY = rf"{_CAP}(?: {_CAP})*"
_UNIT = r"(?:,? (?:Apt|Apartment|Suite|Ste|Unit|Floor|Room|Flat|#)\.? ?[\w-]+)?"
_GERMAN_WAY = r"(?:str\.|straße|strasse|gasse|weg|platz|allee|ring|ufer|damm|graben|steig)"
_CODE_CITY = re.compile(rf"(?<!\d)(?:\d{{5}}|\d{{2}}-\d{{3}}|\d{{4}} ?[A-Z]{{2}}|\d{{4}}) {_UP}")
# (mark, pattern, whether how many words the city has is left open)
ADDRESSES = tuple(
    (re.compile(g) if isinstance(g, str) else g, re.compile(p), o)
    for g, p, o in (
        (r"[A-Z]{2} \d{5}", rf"(?<![\w.])\d{{1,6}}[A-Za-z]? (?:[NSEW]{{1,2}}\.? )?(?:{_CAP} |\d+(?:st|nd|rd|th) )+?{_US_WAY}{_UNIT},? {_CITY},? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?(?!\d)", False),
        (r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b", rf"(?<![\w.])(?:(?:Flat|Unit|Apartment) \w+, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} )+?{_US_WAY}{_UNIT},? {_CITY},? [A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}(?!\w)", False),
        (_CODE_CITY, rf"(?<!\w)(?:(?:Am|An der|Im|Auf der|Zum|Zur|Alte|Neue) )?{_CAP}(?:{_GERMAN_WAY}|(?: (?:Straße|Str\.|Weg|Platz|Allee|Gasse|Ring|Ufer|Damm))) \d{{1,4}} ?[a-z]?,? (?:D-)?\d{{4,5}} {_CITY}", True),
        (_CODE_CITY, rf"(?<!\w)(?:Calle|Avenida|Avda\.|Av\.|C/|Plaza|Paseo|Camino|Carrera|Ronda|Rúa|Via|Viale|Piazza|Corso|ul\.|al\.|Rua)(?: (?:de|del|la|las|los|el|di|della|dei|do|da))* ?{_CAP}(?: (?:de |del |la |di )?{_CAP})*,? (?:n\.?º ?)?\d{{1,4}}[A-Za-z]?(?:, ?\d{{1,2}}\.?[ºª°](?: ?[A-Za-z])?)?(?: (?:izq|dcha)\.?)?,? (?:\d{{5}}|\d{{2}}-\d{{3}}) {_CAP}(?: (?:de |del |la )?{_CAP})*", True),
        (_CODE_CITY, rf"(?<![\w.])\d{{1,4}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|avenue|av\.|boulevard|bd|place|allée|impasse|chemin|quai|cours|route|square)(?: (?:de|du|des|de la|d'|de l'|le|la|les))*[ ']?{_CAP}(?:[ -](?:de |du |des |la )?{_CAP})*,? \d{{5}} {_CAP}(?:[ -]{_CAP})*", True),
        (_CODE_CITY, rf"(?<!\w){_CAP}(?:straat|laan|weg|plein|kade|gracht) \d{{1,4}} ?[a-zA-Z]?,? \d{{4}} ?[A-Z]{{2}} {_CITY}", True),
    )
)
ADDRESS_CJK = re.compile(r"(?:[一-鿿]{2,3}省)?[一-鿿]{2,4}?市(?:[一-鿿]{1,4}?[区县])?[一-鿿]{1,8}?(?:路|街|道|巷|大道|胡同)\d{1,5}(?:弄\d{1,4})?号(?:[一-鿿]{2,8}(?:小区|大厦|花园|公寓))?(?:\d{1,4}(?:号楼|栋|幢|座|单元)){0,2}(?:\d{1,3}[层楼])?(?:\d{1,5}室)?")

_TOKEN = rf"(?:{_UP}\.|{_CAP})"
NAME_RUN = re.compile(rf"(?<!{_LETTER})(?<![@./\-]){_TOKEN}(?: (?:{_SMALL} )?{_TOKEN})+")
NAME_TURNED = re.compile(rf"(?<!{_LETTER})(?<![@./\-]){_CAP}(?: {_CAP})*, {_TOKEN}(?: {_TOKEN})*(?!@|{_LETTER})")
NAME_CJK = re.compile(r"(?<![一-鿿])[一-鿿]{2,4}(?![一-鿿])")
# The one-character family names of the Hundred Family Surnames, in the book's order. A fixed text.
SURNAMES = frozenset(
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄"
    "和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚"
    "程嵇邢滑裴陆荣翁荀羊於惠甄曲家封芮羿储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭厉戎祖武符刘景詹束龙叶幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙池乔阴胥能苍双闻莘党翟"
    "谭贡劳逄姬申扶堵冉宰郦雍郤璩桑桂濮牛寿通边扈燕冀郏浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东欧利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚简饶空曾沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公岳帅缑亢况商牟佘佴墨哈谯笪年爱阳佟言福"
)
# Signs after which a name may begin within a Chinese sentence, and signs that may follow one. Fixed values.
CJK_BEFORE = frozenset("系人是叫名者找问给由和与及向请跟让被替同见谢户友")
CJK_ROLES = "联系 联系人 收件人 寄件人 收货人 负责人 申请人 经办人 主人 客人 户主 用户 客户 作者 姓名 名字 大名 经理 主管 同事 老师 先生 女士 医生 律师 师傅 麻烦 感谢 谢谢 询问 拜托 请问 有请 烦请 抄送 转告 名叫".split()
CJK_AFTER = frozenset("的说在处负来看给和与会已要把也就是不将去反提写做告回发认先住有能可想问写加用请同修主帮很都又还没刚昨今明于从到经审批")
CJK_CUE = re.compile(rf"(?:{'|'.join(CJK_ROLES)})(?:是|为|叫)?[：: “\"]{{0,2}}$")
CJK_NAME = re.compile(rf"[{''.join(sorted(SURNAMES))}](?=[一-鿿])")

_WORDS = lambda s: frozenset(s.split())
# General vocabulary: function words, words of user interfaces, computing and makers, places and the calendar. Fixed values.
FUNCTION = _WORDS(
    "the a an and or but if when while after before because since so then than as at by for from in into of on onto to with without about please we i you he she it they our my your his her its their this that these those there here now next first last some any no not each every both either "
    "what who whom whose which why how can could may might must shall should will would do does did have has had is are was were be been being let get got see use try make run add set keep also only just even again all most more many few new old same other "
    "der die das den dem des ein eine einen einer und oder aber wenn weil dass bitte wir ich du er sie es mit ohne für von vom zum zur auf aus bei nach vor über unter nicht ist sind war hat haben wird werden kann soll noch auch nur schon "
    "el la los las un una y o pero si cuando porque que con sin por para de del al en es son fue ha han no más este esta ese esa como ya también antes después le les et ou mais avec sans pour dans sur est sont qui que ce cette il elle nous vous au aux"
)
INTERFACE = _WORDS(
    "file edit view window help menu button tab page panel dialog toolbar sidebar settings options preferences profile account console dashboard editor browser screen icon link form field list table row column cell chart report search filter sort open close save delete remove cancel apply submit confirm reset refresh retry "
    "continue back forward upload download import export print copy paste undo redo select click press enter login logout sign access role roles policy policies group groups project projects issue issues request requests pull merge branch release resolved pending draft default theme dark light mode step note notes todo warning error info debug"
)
COMPUTING = _WORDS(
    "apache amazon aws azure google cloud microsoft oracle ibm intel nvidia apple meta delta iceberg kafka spark flink hadoop hive airflow docker kubernetes helm terraform ansible linux ubuntu debian fedora windows android ios macos python java javascript typescript kotlin swift rust golang ruby perl node react angular vue django flask "
    "spring boot maven gradle postgres postgresql mysql redis mongo mongodb sqlite snowflake databricks elastic elasticsearch grafana prometheus jenkins github gitlab bitbucket jira confluence slack teams zoom chrome firefox safari edge visual studio code server service client api http json xml yaml html css sql cli sdk cpu gpu ram "
    "test tests build builds suite main thread process worker queue stream batch cache index schema data database model pipeline cluster engine runtime framework library platform system systems lake warehouse network security group team core web app apps"
)
PLACES = _WORDS(
    "san los las new north south east west saint santa york francisco angeles london paris berlin madrid rome tokyo beijing shanghai delhi mumbai sydney toronto chicago boston texas california europe asia africa america united states kingdom republic street avenue road lake river valley city county park university institute college school"
)
CALENDAR = _WORDS("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag lunes martes miércoles jueves viernes")
TITLES = _WORDS("mr mrs ms miss dr prof herr herrn frau sr sra señor señora don doña monsieur madame mme m signor signora sir madam dear hi hello hey hallo hola bonjour liebe lieber cher chère estimado estimada")
ROLES = _WORDS(
    "author owner maintainer reviewer contact customer client patient employee assignee manager engineer colleague lead user recipient sender name fullname holder applicant tenant student teacher lawyer nurse driver autor autora nombre cliente clienta usuario responsable kunde kundin nutzer ansprechpartner name nom auteur utilisateur by attn cc fn"
)
REACHING = _WORDS("ask asked call called ping pinged tell told email emailed mail mailed thank thanks message notify meet met invite inform contact paged page reach consult cc bcc loop frag frage fragen gefragt rufe pregunta preguntar escribe escribir habla llama llamar avisa voir joindre contacter demander and und y et or with mit con avec from von de by für para pour to an per laut según selon")
SAYING = _WORDS(
    "said says wrote writes asked asks replied reported reports thinks thought mentioned mentions approved reviewed joined left works worked lives lived called agreed agrees noticed confirmed wants wanted will has had is was and or should could would can cannot may found opened closed fixed owns prefers hat ist sagt sagte meint wohnt schrieb meldete dijo dice escribió vive pidió trabaja abrió tiene es y und et a habite travaille signale"
)

_LABEL = r"[\w\s.;=:：#\"'(（<>-]{0,16}$"
PHONE_LEFT = re.compile(rf"(?i)(?:tel|phone|call|mobile|cell|sms|text|fax|hotline|number|num|telef|telé|handy|whatsapp|reach|contact|dial|ring|msisdn|pager|desk|line|erreichbar|rückruf|llama|joindre|au|电话|手机|座机|热线){_LABEL}")
ID_LEFT = re.compile(rf"(?i)(?:ssn|social|national|tax|passport|\bpass|nid|nino|\bdni|\bnie|\bnif|cpf|aadhaar|\bpan\b|pesel|bsn|curp|steuer|ausweis|\bid\b|identity|identif|taxpayer|licen[sc]e|valid|insurance|personal|document|numéro|身份证|护照|证件|税号){_LABEL}")
PLACE_LEFT = re.compile(rf"(?i)(?:addr|street|label|deliver|ship|send|sent|moved|lives|office|site|visit|home|hq|billing|return|located|parcel|package|geocod|residen|reside|domicil|anschrift|adress|dirección|wohn|vive|habite|地址|寄|位于|住|at|to|from|an|in|en|à){_LABEL}")
MAIL_LEFT = re.compile(rf"(?i)(?:mail|correo|courriel|邮箱|邮件|<|to=|to:|cc|from|login|account|account of|writes|reply|contact|send|user|notify|forward|bounce|write|an|a|à){_LABEL}")
TECH_LEFT = re.compile(
    r"(?i)(?:build|order|invoice|ticket|pid|tid|ts|time|range|offset|port|version|ver|v|rev|line|addr|trace|span|took|bytes|size|count|total|seq|step|epoch|release|hash|sha\d*|md5|0x|timeout|limit|window|stack|serial|sku|isbn|doi|card|account|job|run|commit|request|session|row|rows|key|code|clone|install|ssh|scp|rsync|docker|make|see|@@|#|uuid|id|ip|host|url|http\S*|in|of|after|ms)[\s:=#@\"'(\[]{0,3}[\w.,\- /:]{0,8}$"
)
DIGITS = re.compile(r"\D")
COMMAND_USERS = frozenset("git root app ci deploy ubuntu admin svn hg ec2-user user node postgres www-data oauth2 x-access-token builder runner jenkins backup service".split())
FILE_ENDS = frozenset("png jpg jpeg gif svg webp ico js mjs ts tsx jsx py rb go rs java json css scss md rst yml yaml toml xml html tar gz tgz zip whl jar latest lock txt log sh".split())


def _sub_runs(m: re.Match) -> Iterator[tuple[int, int]]:
    """Successive groups of a run of digits with 7 to 15 digits in all."""
    groups = [(g.start(), g.end(), sum(map(str.isdigit, g.group()))) for g in _GROUP.finditer(m.group())]
    for i, (b, _, _) in enumerate(groups):
        total = 0
        for _, e, n in groups[i:]:
            total += n
            if total > 15:
                break
            if total >= 7:
                yield m.start() + b, m.start() + e


def _name_spans(text: str, m: re.Match) -> Iterator[tuple[int, int]]:
    """Stretches of two to eight words of a run, and the whole of a longer one."""
    tokens, at = [], m.start()
    for t in m.group().split(" "):
        tokens.append((at, at + len(t), t[0].isupper(), len(t) > 1 and t[-1] != "."))
        at += len(t) + 1
    for i, (b, _, up, _) in enumerate(tokens):
        for _, e, cap, full in tokens[i + 1 : i + 8] if up else ():
            if cap and full:
                yield b, e
                if text[e - 2 : e] in ("'s", "’s") and e - 2 > b:
                    yield b, e - 2
    if len(tokens) > 8:
        yield m.start(), m.end()


_ROLE_ENDS = tuple(CJK_ROLES)


def _cjk_opens(text: str, at: int) -> bool:
    """Whether a name may begin here: at the start of a run of Chinese signs, or after a sign or word that names follow."""
    before = text[at - 1 : at]
    return not _cjk(before) or before in CJK_BEFORE or text.endswith(_ROLE_ENDS, 0, at - (before == "为"))


def candidates(text: str) -> list[Span]:
    """Overlapping spans of all kinds; meant to miss nothing, not to be right."""
    out: dict[tuple[int, int, int], Span] = {}

    def add(kind: int, begin: int, end: int, form: int) -> None:
        out.setdefault((kind, begin, end), Span(kind, begin, end, form))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(0, m.start(), m.end(), 0)
    if SPELLED_MARK.search(text):
        for m in EMAIL_SPELLED.finditer(text):
            add(0, m.start(), m.end(), 1)
    for m in PHONE.finditer(text):
        if m.end() - m.start() >= 7:
            for b, e in _sub_runs(m):
                add(1, b, e, 0)
    for m in ID_START.finditer(text):
        for i, p in enumerate(IDS):
            if got := p.match(text, m.start()):
                add(2, got.start(), got.end(), i)
    coded = bool(_CODE_CITY.search(text))
    for i, (mark, p, city_open) in enumerate(ADDRESSES):
        if coded if mark is _CODE_CITY else mark.search(text):
            for m in p.finditer(text):
                add(3, m.start(), m.end(), i)
                if city_open:
                    tail = re.search(r"(?<=\d |[A-Z] )[^\W\d].*$", m.group())
                    for s in re.finditer(" ", tail.group()) if tail else ():
                        add(3, m.start(), m.start() + tail.start() + s.start(), i)
    if "号" in text:
        for m in ADDRESS_CJK.finditer(text):
            add(3, m.start(), m.end(), 9)
            for n in (3, 2):  # where the city's name begins is open
                if (at := text.find("市", m.start(), m.end()) - n) > m.start():
                    add(3, at, m.end(), 9)
    for m in NAME_RUN.finditer(text):
        for b, e in _name_spans(text, m):
            add(4, b, e, 0)
    for m in NAME_TURNED.finditer(text):
        family, own = m.group().split(", ", 1)
        begins = [0] + [x.end() for x in re.finditer(" ", family)]
        ends = [x.start() for x in re.finditer(" ", own)] + [len(own)]
        for b in begins:
            for e in ends:
                if not own[:e].endswith(" "):
                    add(4, m.start() + b, m.start() + len(family) + 2 + e, 1)
    for m in NAME_CJK.finditer(text):
        add(4, m.start(), m.end(), 2)
    for m in CJK_NAME.finditer(text):
        for n in (2, 3) if _cjk_opens(text, m.start()) else ():
            if m.start() + n <= len(text) and all("一" <= c <= "鿿" for c in text[m.start() : m.start() + n]):
                add(4, m.start(), m.start() + n, 3)
    return list(out.values())


_SIGNS = {'"': 5, "'": 5, "<": 6, ">": 6, "(": 7, ")": 7, "（": 7, "）": 7, ",": 8, ";": 8, "|": 8, "，": 8, "、": 8, "。": 9, ".": 9, "!": 9, "?": 9, ":": 10, "：": 10, "/": 11, "@": 12, "-": 13, "=": 14, "_": 15}


def _class(c: str) -> int:
    if not c:
        return 0
    if c == "\n":
        return 1
    if c.isspace():
        return 2
    if c.isdigit():
        return 3
    if c.isalpha():
        return 4
    return _SIGNS.get(c, 16)


def _date(d: str) -> bool:
    return len(d) >= 14 and d[6:8] in ("19", "20") and "01" <= d[10:12] <= "12" and "01" <= d[12:14] <= "31"


@lru_cache(maxsize=1 << 12)
def _line_facts(line: str) -> tuple[float, ...]:
    """Signs of tables, addresses and code in a line, and its length."""
    n = max(len(line), 1)
    return line.count("|") + line.count(";") + line.count("\t"), line.count(","), float("@" in line or "[at]" in line or "(at)" in line), (len(line) - len(_CODE_SIGNS.sub("", line))) / n, len(line), (len(line) - len(_ANY_DIGIT.sub("", line))) / n


_CODE_SIGNS, _ANY_DIGIT = re.compile(r"[(){}\[\]=;_<>]+"), re.compile(r"\d+")
_NONE = (17.0, 17.0)
_BEFORE = re.compile(r"([\w'’.-]+)[ :：\"'(<]{1,3}$")
_AFTER = re.compile(r"[ ,]{1,2}([\w'’-]+)")


def _cjk(c: str) -> bool:
    return "一" <= c <= "鿿"


def _person(val: str, low: list[str], left: str, near: str, s: Span, lex: Lexicon) -> list[float]:
    if _cjk(val[0]):
        return [0.0] * 24 + [1.0, val[0] in SURNAMES, len(val), _cjk(left[-1:]), _cjk(near[:1]), left[-1:] in CJK_BEFORE, bool(CJK_CUE.search(left)), left[-1:] in ("叫", "找", "让", "问"), near[:1] in CJK_AFTER, val[-1] in CJK_AFTER, near[1:2] != "" and _cjk(near[1:2])]
    parts = [p for t in low for p in t.split("-") if p]
    ranks = [lex.ranks.get(t, _NONE) for t in parts] or [_NONE]
    first, last = ranks[0], ranks[-1]
    given = [t in lex.given for t in parts] or [False]
    tokens = [t for t in re.split(r"[ ,]+", val) if t]
    kinds = [sum(t in w for t in parts) for w in (FUNCTION, INTERFACE, COMPUTING, PLACES, CALENDAR)]
    return [
        given[0], given[-1], sum(given), s.form == 1 and any(t in lex.given for t in low[-2:]),
        first[0], first[1], last[0], last[1], max(r[0] for r in ranks), min(r[0] for r in ranks), first[0] - first[1], last[0] - last[1],
        *kinds, parts[0] in FUNCTION or parts[0] in INTERFACE, parts[-1] in INTERFACE or parts[-1] in COMPUTING,
        any(len(t) == 2 and t[1] == "." for t in tokens), val.isupper(), min(map(len, parts), default=0), sum(bool(re.search(r"[a-z][A-Z]|\d|_", t)) for t in tokens), len(parts),
    ] + [0.0] * 11


def features(text: str, s: Span, lex: Lexicon) -> list[float]:
    """Format and context of a span: N_FEATURES numbers."""
    val = text[s.begin : s.end]
    left, right = text[max(0, s.begin - 48) : s.begin], text[s.end : s.end + 32]
    left = left[left.rfind("\n") + 1 :]
    cut = right.find("\n")
    near = right if cut < 0 else right[:cut]
    digits = DIGITS.sub("", val)
    # A line of 400 signs and more is described by the 200 on either side, so no more of it is looked at.
    far, near_end = max(0, s.begin - 400), min(len(text), s.end + 400)
    begin = text.rfind("\n", far, s.begin) + 1 or far
    end = text.find("\n", s.end, near_end)
    line = text[begin : end if end >= 0 else near_end]
    line = line if len(line) < 400 else line[max(0, s.begin - begin - 200) : s.end - begin + 200]
    person, mail = s.kind == 4, s.kind == 0
    low = [t.strip(".'’").lower() for t in re.split(r"[ ,]+", val) if t.strip(".'’")]
    before, after = _BEFORE.search(left), _AFTER.match(near)
    b = before.group(1).strip(".-").lower() if before else ""
    a = after.group(1).lower() if after else ""
    domain = re.split(r"@|[\[({<] ?(?:at|ät|arroba|chez) ?[\])}>]| (?:at|AT|arroba|chez) ", val, maxsplit=1, flags=re.I)[-1].strip() if mail else ""
    local = val.split("@", 1)[0].lower() if mail else ""
    groups = [len(g) for g in re.split(r"\D+", val) if g] if s.kind in (1, 2) else []
    url = left.rfind("://")
    return [
        *(float(s.kind == k) for k in range(5)), float(s.form),
        len(val), len(digits), len(low), sum(map(str.isupper, val)), val.count(" "), val.count("-"), val.count("."), val.count(","), val.count("/"),
        float(val[0] == "+"), float(val[0] == "("), float(val[:2] == "00"), float(val[:1] == "0"), float(digits[:1] == "1"), float(digits[:1] == "9"),
        *(groups[k] if k < len(groups) else 0 for k in range(4)), groups[-1] if groups else 0, len(groups), float(len(set(groups)) == 1),
        float(s.kind == 2 and _date(digits)), float(val[-1:].isalpha()), float(bool(re.match(r"(?:19|20)\d\d[-./ ]?[01]\d[-./ ]?[0-3]\d", val))),
        _class(left[-1:]), _class(right[:1]), _class(left[-2:-1]), _class(right[1:2]),
        # Each kind has trees of its own and looks at the labels that concern it.
        float(s.kind in (1, 2) and bool(PHONE_LEFT.search(left))), float(s.kind in (1, 2) and bool(ID_LEFT.search(left))), float(s.kind == 3 and bool(PLACE_LEFT.search(left))), float(mail and bool(MAIL_LEFT.search(left))), float(not person and bool(TECH_LEFT.search(left))),
        float(not left.strip()), float(not near.strip()), *_line_facts(line),
        float("." in domain or "dot" in domain.lower()), float(mail and domain.rsplit(".", 1)[-1].isalpha()), float(mail and domain.rsplit(".", 1)[-1].lower() in FILE_ENDS), float(local in COMMAND_USERS),
        float(mail and right[:1] in (":", "/") and right[1:2] not in ("", " ", "\n")), float(mail and url >= 0 and " " not in left[url:]), float(local.isdigit()),
        float(b in TITLES), float(b in ROLES or b.rsplit("_", 1)[-1] in ROLES or b.endswith("name")), float(b in REACHING), float(b in FUNCTION), float(b in INTERFACE or b in COMPUTING), float(b in lex.given), float(bool(b) and before.group(1)[0].isupper()),
        float(a in SAYING), float(a in FUNCTION), float(a in INTERFACE or a in COMPUTING), float(bool(a) and after.group(1)[0].isupper() and near[:1] == " "), float(bool(re.match(r",? \d| ?<|\s?\(", near))),
        float(person and bool(re.match(rf", {_UP}", near))), float(person and bool(re.search(rf"{_UP}[\w-]*, $", left))),
        float(person and bool(re.search(r"(?:\d+[A-Za-z]? |rue |Calle |des |Via )$", left))), float(person and bool(re.search(r"(?:import|class|await|new|return|raise|from|def|func|except|extends) $|[=({\[] ?$", left))),
        *(map(float, _person(val, low, left, near, s, lex)) if person else [0.0] * 35),
    ]


N_FEATURES = len(features("a", Span(0, 0, 1, 0), Lexicon(frozenset(), {})))
