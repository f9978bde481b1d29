"""Labelled rows for the classifier: sentences, tables, logs and code with marked items, and lines that only look alike.

The rows are made from a seed, so their number is a parameter and every label is certain. All sentences, names, streets
and number shapes are written or invented here, from general knowledge of the formats; no input table was a source. The
only outside helps are the given names and the word list passed in.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from trailbed.llm.pii_candidates import COMPUTING, INTERFACE, KINDS, PLACES, SURNAMES

# Common given names of many languages. Fixed values.
GIVEN = (
    "Aaron Abdul Abigail Adam Adrian Agnes Ahmed Aisha Akira Alan Albert Alejandro Aleksandr Alexander Ali Alice Alina Amina Amir Amy Ana Anders Andrea Andrei Andrew Angela Anil Anja Anna Anne Antonio Anya Arjun Arthur Astrid Barbara Beatriz Benjamin Bernd Bjorn Boris Brian Bruno Camille Carlos Carmen Caroline Catherine "
    "Chen Chiara Chloe Christian Christina Claire Claudia Cristina Daniel David Deepak Diego Dmitri Dorothy Edward Elena Elif Elizabeth Emeka Emily Emma Enrique Erik Esther Eva Fatima Felix Fernando Fiona Francesco François Frank Gabriel George Giulia Grace Greta Guillaume Gustav Hans Hassan Helen Helga Henrik Hiroshi Hugo Ibrahim Ines Ingrid "
    "Irina Isabel Ivan Jack Jakub James Jan Jean Jennifer Jérôme Jessica Joan Johan John Jorge José Juan Julia Julien Jürgen Karin Karl Katarzyna Kenji Kevin Kwame Lars Laura Leila Leon Li Lin Linda Lucía Luis Łukasz Lukas Magdalena Manuel Margaret Maria Marie Mario Marta Martin Mary Mateusz Matthias Mei Michael Miguel Mohammed"
).split()
# Common family names of many languages, for the shapes they have. Fixed values.
FAMILY = (
    "Abbott Adeyemi Aguilar Ahmadi Almeida Andersson Baker Banerjee Bauer Becker Bianchi Blanc Bondarenko Campbell Castro Chandra Clarke Costa Delgado Díaz Dubois Dvořák Eriksen Evans Fernández Ferrari Fischer Fontaine Fraser García Gomez González Grünwald Gupta Haas Hansen Hernández Hoffmann Horvath Ivanova Iyer Jansen Jensen Johansson Jones "
    "Kamiński Kaur Keller Khan Kim Kovács Kowalska Krishnan Krüger Laurent Lefèvre Lehmann Lindqvist López Maier Marino Martínez Mehta Mendoza Meyer Moreau Moreno Müller Murphy Nakamura Navarro Nguyen Nielsen Novák Nowak O'Brien O'Connor Okafor Olsen Park Patel Pereira Petrov Popescu Ramos Rao Reyes Richter Rojas Romano Rossi Roux Ruiz Santos Sato Schmidt "
    "Schneider Sharma Silva Singh Smirnova Smith Sokolov Suzuki Takahashi Taylor Thompson Torres Tremblay Vargas Vasquez Virtanen Volkov Wagner Walker Weber White Williams Wójcik Wolff Wright Yamamoto Yılmaz Young Zhang Zieliński"
).split()
_ONSET = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sch sh sk sl sm sn sp st str t th tr v w wh z".split()
_VOWEL = "a a e e i o u ai au ea ei ie oo ou ü ö é á".split()
_CODA = "n r l s t d m ck ng nd rt ll th x".split() + [""] * 8
_END = "er man son ton field well wood brook land stein berg dorf hoff feld ini etti ova ev ko enko ski cki wicz ic ez es eira aux ard et oux ingh wala kar amoto ura a o i y".split()
_CJK_GIVEN = "伟芳秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂文辉玲建国志红玉春海燕晓东雪梅子轩浩然宇欣怡梓涵诗雨思远博嘉琪俊熙若晨光亮鹏飞丹婷佳颖慧琳凯瑞峰翔宁"
_STREET = "Maple Oak Cedar Elm Pine Washington Lincoln Jackson Church High Station Victoria Queens Mill Spring Lake Ridge Sunset Willow Chestnut Franklin Highland Park Garden Bridge Forest Meadow Harbour Union Market Orchard".split()
_STREET_DE = "Haupt Schul Garten Bahnhof Kirch Berg Linden Wald Wiesen Goethe Schiller Mozart Beethoven Birken Rosen Mühlen Eichen Post Markt Feld Brunnen Ahorn Kant Luisen Friedrich".split()
_TOWN = "Springfield Riverton Ashland Fairview Georgetown Salem Clinton Madison Milton Newport Oxford Bristol Leeds York Bath Derby Norwich Potsdam Kassel Bremen Mainz Ulm Jena Fulda Köln Münster Sevilla Málaga Burgos Toledo Lugo Lyon Nantes Lille Dijon Tours Reims Utrecht Leiden Parma Modena Kraków Gdynia".split()
_CJK_TOWN = "北京 上海 广州 深圳 成都 杭州 南京 武汉 西安 苏州 天津 长沙 青岛 宁波 厦门 昆明 东莞 福州 无锡 合肥".split()
_CJK_STREET = "中山 人民 解放 建设 和平 新华 长江 黄河 文化 学院 友谊 胜利 滨海 科技 锦绣 湖滨 桂花 梅园 望江 迎春".split()
_STATE = "AL AZ CA CO CT FL GA IL IN KS MA MD MI MN MO NC NJ NM NV NY OH OR PA TN TX UT VA VT WA WI".split()
_ROLE = "Signed-off Reviewed Acked Tested Reported Helped Suggested Co-authored".split()
_CJK_NOUN = "程序 接口 模块 配置 任务 日志 数据 文档 脚本 版本 分支 权限 参数 变量 函数 方法 字段 线程 进程 缓存 队列 连接 请求 响应 页面 按钮 表格 用户 系统 服务 平台 网络 磁盘 内存 时间 结果 问题 原因 单元 仓库 镜像 容器 节点 索引 视图 事务 报表 订单 支付 消息 通知 邮箱 密码 金额 计划 方案 项目 代码 注释 文件 目录 工具 环境 测试 应用 高峰 常量 安全 包名 时区 易错点 管道 通道 元素 和值 方向 平均值 成本 向量 任意值 余量 万一 全部 关键字 明细 于此".split()
_CJK_VERB = "对齐 校对 比对 处理 整理 清理 求和 求解 请求 超时 同步 对照 报错 抛出 检查 更新 删除 添加 修改 重启 部署 回滚 合并 提交 运行 测试 编译 调用 返回 解析 加载 保存 读取 写入 连接 断开 监控 重构 排查 修复 关闭 打开 上传 下载 同步 迁移 备份 恢复 发布 升级 过滤 排序 统计 计算 查询 匹配 替换 转换 验证 授权 登录 退出 注册 等待 停止 缩小 扩大 安装 卸载 计时 封装 查找 解锁 管理 关联 包装 分析 应对 时延".split()
_CJK_ADVERB = "先 再 已经 还没 不能 可以 必须 需要 应该 正在 都 就 也 只 经常 有时 刚刚 暂时 直接 重新 马上 一起 从来没有 不要 尽量 立即 于是 和以前一样".split()
_GERMAN_NOUN = "Änderung Prüfung Datei Anfrage Sitzung Migration Tabelle Spalte Fehler Warteschlange Abfrage Einstellung Schaltfläche Ausgabe Eingabe Anwendung Umgebung Verbindung Lösung Klasse Methode Schnittstelle Version Freigabe Sicherung Laufzeit Zeile Liste Meldung Aufgabe Woche Stunde".split()
_INTERFACE, _COMPUTING, _PLACES = ([w.capitalize() for w in sorted(words)] for words in (INTERFACE, COMPUTING, PLACES))
_SURNAMES = sorted(SURNAMES)
_HOSTS = "example.com internal.test intra.local git.sample.org svc.cluster repo.invalid".split()
_KEYS = {
    "email": "email mail e_mail userEmail contact_email mailbox login".split(), "phone": "phone tel mobile cell phone_number contactPhone fax msisdn".split(), "idnum": "ssn tax_id passport national_id nid idNumber dni document".split(),
    "address": "address addr street home_address shipTo billing_address location".split(), "person": "name full_name fullname customer owner contact displayName assignee".split(),
}
_ID_WORDS = "SSN|social security no.|ITIN|passport|passport number|national ID|tax ID|tax number|DNI|NIE|NIF|CPF|PESEL|BSN|Aadhaar|PAN|NINO|Ausweisnummer|Steuernummer|personal number|ID card|identity no.".split("|")

# Templates by | and line; ⏎ is a line break, {…} an item, which is marked, or a word, number or label that is none.
_ITEMS = """Could you loop in {person} on this thread?|{person} from billing opened this on Monday|Hi {person}, the nightly export is late again|Dear {person},|{person} will demo the change on Friday.|Spoke with {person}; they prefer the older {w}.|As per {person}, both stay.|cc {person}, {person}|Paired with {person} and {person} on it.
Meeting notes by {person}|Contact: {person}, {phone}, {email}|Customer {person} moved to {address}.|{person}'s laptop still has it checked out|Assigned to {person} ({email})|paged {person} via {phone}|reach {person} under {phone} or {email}|You can text {phone} any time.|Fax {phone}|their direct line: {phone}|voicemail from {phone} about the {w}|dial {phone} then press 2
phone={phone}|contact_phone: {phone}|"msisdn": "{phone}"|whoever owns {email} should rotate it|forwarded by {email} on behalf of {person}|bounce for {email}: mailbox full|login name is {email}|notify={email}|From: {person} <{email}>|To: {email}|Reply-To: {email}|smtp: rcpt <{email}> accepted|delivered id={n} rcpt="{email}" code=250|sent mail, rcpt={email}, {n} bytes
{role}-by: {person} <{email}>|{role}-by: {person}|/* written by {person}, {year} */|# {person} {year}|@author {person}|// TODO({person}): drop the {w}|__maintainer__ = "{person}"|author = '{person} <{email}>'|<td>{person}</td><td>{phone}</td>|<b>{person}</b>|<a class="c" href='mailto:{email}'>{person}</a>|({n}, '{person}', '{email}'),|({n}, "{person}", "{phone}", "{address}")
{id}: {idnum}|{id} {idnum}|my {id} is {idnum}|scan shows {id} {idnum} expired|taxpayer {person}, {id} {idnum}|parse_id("{idnum}")|'{idnum}' fails the checksum|applicant's {id} ({idnum})|holder {person} {id} {idnum}|expect(check("{idnum}")).toBe(true)|{person}, born {year}-03-12, {id} {idnum}|is {idnum} a valid {id}?|he typed {idnum} as {id}
Home address: {address}|parcel for {person}, {address}|Returns: {address}|site visit at {address} tomorrow|HQ - {address}|registered at {address}|lives at {address}|pick it up from {address}|billing_address = "{address}"|shipTo: {address}|geocode('{address}')|{person}, {address}|{address}|the map pin for {address} is wrong|we sent two boxes to {address} today|{person} ({address}) never got it
Frag mal {person}, ob das {w} noch läuft.|Laut {person} ist das ein alter Fehler.|Ansprechpartner: {person}, Tel. {phone}|{person} hat das gestern gemeldet.|Rückruf unter {phone} erbeten|Anschrift: {address}|Paket an {person}, {address}|Herr {person} kommt aus {address}.|Mail an {email} genügt.|Bitte bei {person} melden.|Bitte {person} anrufen.|Wenn {person} kommt, geht es weiter.|Wer kennt {person}?|Cuando {person} vuelva, lo vemos.|Si {person} acepta, seguimos.|Quand {person} revient, on publie.|If {person} agrees, ship it.|When {person} is back we merge.|Because {person} left, nobody owns it.|Only {person} knows the {w}.|Maybe {person} can help|And {person} too.|Yesterday {person} found it.|While {person} is away, skip it.|Before {person} starts, {v} it.|Bitte {person} Bescheid geben.|Nummer {idnum} wird abgelehnt|Kollegin {person} übernimmt ab morgen.|Neue Anschrift: {address}
Según {person}, el {w} ya no se usa.|Habla con {person} antes del viernes.|{person} abrió la incidencia.|Mi número es {phone}.|Domicilio: {address}|El señor {person} reside en {address}.|Manda el informe a {email}.|El documento {idnum} no pasa.|Avisa a {person} ({phone}).|Gracias, {person}|Voir avec {person} pour le {w}.|{person} a signalé la panne hier.|Joindre {person} au {phone}.|Adresse : {address}|Courriel {email}|Le numéro {idnum} est refusé.
麻烦{person}看一下这个{w}|账号属于{person}，电话 {phone}|户主叫{person}，住{address}|收货人{person}|申请人{person}，{id} {idnum}|{person}说周五前能修好。|{person}提了一个问题|{person}负责这个{w}|{person}觉得太慢了|{person}今天不在|{person}和{person}一起改的|{person}的电脑坏了|{person}已经离职|{person}发现了原因|{person}，你好|由{person}审核|昨天和{person}讨论过了|负责人：{person}，手机 {phone}|开发者{person}提交了补丁|寄件地址：{address}|我的邮箱是 {email}|证件号码 {idnum} 无法通过|会议由{person}主持|感谢{person}的帮助|让{person}回电话 {phone}|姓名：{person}|客户{person}住在{address}|问一下{person}。|找{person}要权限|抄送{person}和{person}|{person}：收到|经理{person}已经批准|手机号{phone}收不到短信|护照 {idnum} 过期|这段代码是{person}写的，有问题找{person}。|联系人是{person}。
Cheers,⏎{person}⏎{phone}|Regards,⏎{person}⏎{email}|Atentamente,⏎{person}⏎{phone}|Mit freundlichen Grüßen⏎{person}⏎{email}|Cordialement,⏎{person}|-- ⏎{person}⏎{address}|{person}⏎{email}⏎{phone}|{person}|{phone}|{email}|N:{person}⏎TEL:{phone}⏎ADR:{address}|TEL;VALUE=uri:{phone}|NOTE:{person}|ORG;{email}"""
_PLAIN = """git@{site}:{w}/{w}.git|clone https://ci:{pw}@{site}/{w}.git|https://{w}:{pw}@{site}/simple|mysql://admin:{pw}@{site}:{n5}/{w}|amqp://{w}:{pw}@{site}|url = {w}://{w}:{pw}@{site}:{n4}/{w}|{W}_URL={w}://{w}:{pw}@{site}/{w}|pip install git+ssh://git@{site}/{w}/{w}|svn+ssh://{w}@{site}/{w}|yarn add @{w}/{w}@{ver}|npx {w}@latest|docker pull {site}/{w}@sha256:{hex}{hex}|hero@3x.png logo@2x.webp|{w}@{n1}x.png|icons/{w}@{n1}x.svg missing|{w}@2x.jpg, {w}@3x.jpg|./{w}@2x.gif|{w}@{w}:/var/www$ ls -la|root@{hex}:/# ps aux|user@{w}-{n} ~ % make
rsync -a build/ deploy@{site}:/srv/{w}|ssh -i key.pem ubuntu@10.{n2}.{n2}.{n1}|scp {path} ci@{w}:/tmp|@{w}.route('/{w}')|@dataclass(frozen=True)|@Override public {W} {v}{W}()|actions/checkout@v4|contact <your-email>|tel: [hidden], mail: ***@***|"name": "{{ user.name }}"|the fields email, phone and address may be null|email_verified BOOLEAN, phone VARCHAR({n2})|call it at most {n} times|text at line {n} dot product
Open {T}, then choose {T} and press {U}|Go to {T} > {T}|The {T} dialog shows {n} rows|{G} {o} the {w}?|{G} {O}: {n}|{G} {U} in {n}|{G} {O}; {G} {U} for {w}|{G} {O}?|- {G} {O}|{G} {O} on {n}|* {G} {U} {O}|Then I'd {v} it|Now I'll {v} the {w}|So I've {o} it|But I'm {o}|Here we'd {v} {W}.|{G} {O} in {U} {U}|{G} {U} to {U} {U}|{G} {O}, {O} {G}|{O} {G} mode|{G} {O} {n} times|Click {U} in the {T} panel|{G} {O}|Rule: {G} {O} when idle|{U} {O} {U}|{T}: {n}|= {T} =|## {T}|{T}⏎======|Status: {U} {O}|{UU} {UU}|{UU} {CC} {UU}|== {CC} {UU} ==|{UU} {UU}: {n}|--- {UU} {CC} KEY ---|The {U} {O} is {o}|Use {C} {C} with {C}|{C} {C} on {C} {C}|we moved from {C} {C} to {C} {C}|{C} {C} {ver} is out|Deploy {C} to {P} {P}|{C} {C} and {C} {C} cost more|{P} {P} region is down|Made in {P} {P}|New {T} for {C} {C}
{n2}-{n2}-{n2} {n2}.{n2}|offset {long} limit {n}|built {year}.{n2}.{n2}-{n} from {n6}|{w} {year}.{n1}.{n2}-{n4} {w} {n4}-{n6}|ref {n4}-{n6}|order {n4}-{n6}|po {n5}-{n5}|build {n6}-{n4} order {n6}|{w} {n4}-{n6}|{w}: {n4}-{n6}, {w}: {n6}.{n3}|finished in {n2}.{n} s (pid {n5})|epoch {ts}|epoch_ms={ts}{n3}|span {hex}-{n}-{hex}|bind 10.{n2}.{n2}.{n2}:{n5}|192.168.{n2}.{n2}|HEAD is now at {hex}|corr={hex}-{n4}-{n4}|{hex}{hex}{hex}{hex}  {path}|{year}-0{n1}-1{n1}T0{n1}:16:24Z|{year}-0{n1}-1{n1} 14:37:52,{n3} {U} {w}|[{year}/1{n0}/0{n1} 09:{n2}:{n2}] {o} {w} took {n}
{n4} {n4} {n4} {n4}|{n3} {n3} {n3}|{n3} {n4} {n5}|row {n} of {long}|{n2} {n3} {n3} rows|memory {long} {long} {n}|uid={n4} gid={n4} groups={n4}|card {n4}-{n4}-{n4}-{n4}|ISBN 978-{n1}-{n4}-{n4}-{n1}|doi:10.{n4}/{long}|SKU {AA}{n6}|flight {AA}{n4}|order {long}{n1}, invoice {n5}{n}|ticket {n}-{n5}|part no. {AA}-{n4}-{n3}|serial {AA}{long}|version {n3}.{n3}.{n3}.{n3}|{ver} -> {ver}|tracking {long}{n5}|{n8}{A} is the batch|error 0x{hex}|case {n3}-{n2}-{n4} closed|port {n5} size {long}|{long},{n},{n},{n}|id={long}{long}|key {n5}{n5}{n5}{n3}
  at {W}.{v}({W}.java:{n})|{path}:{n}:{n1}: error: expected ';'|Traceback: {W}Error in {path}|assert {v}({n}) == {n}|{w} = {W}({n}, {n2})|const { {w} } = await {v}{W}()|from {w}.{w} import {W}|from {w}.{w} import {W}, {W}|use {w}::{ {W}, {W} };|import {W}, {W} from "{w}"|class {W}({W}): pass|new {W}<{W}>()|throw new {W}Exception("{w} {n}")|return {W}.{v}({w})|SELECT {w}, SUM({w}) FROM {w} GROUP BY 1|-rw-r--r-- 1 root root {n} Jan {n2} 12:{n2} {w}.{w}|{W} {W} = {w}|{W} and {W} both call {v}_{w}|Then {W} calls {W}.
+{n},{n1} -{n},{n1}|diff --git a/{path} b/{path}|func ({w} *{W}) {v}({w} int)|impl {W} for {W}|if ({w} > {n}) return {n}|CREATE INDEX ON {w}|kubectl get pods -n {w}|{w}-{hex}-{hex} {n1}/{n1} Ready {n}m|FROM {w}:{ver} AS {w}|RUN apt-get update|HTTP/1.1 {n3} Not Found|GET /{w}/{n} 200 {n}ms|Accept: text/html; q=0.{n1}|User-Agent: Mozilla/5.0 (X11; Linux)|{O} {o} the {w}.|The {W} {o} every {w}.|A {o} {w} may {v} twice.|I {v} the {w} because it was {o}.|We should {v} {W} first.|Please {v} {path}.
Bitte {dn} prüfen.|Das {dn} im {w} ist {o}.|Nach der {dn} dauert es {n} ms|Vor der {dn} bitte {dn} prüfen.|Bei der {dn} in {W} fehlt die {dn}.|Ohne {dn} keine {dn}.|Mit der {dn} {O} läuft {w}|Die {dn} von {W} ist {o}.|Seit der {dn} {ver} geht {w} nicht.|In der {dn} steht {n}.|Die Klasse {W} ruft {v}_{w} auf.|Der Dienst {w} antwortet mit {n}.|Erst das Backup prüfen, dann {v}.|Neue Version {ver} ausrollen|Siehe Abschnitt {n1} Tabelle {n1}|El {w} de {path} falla con {n}.|La clase {W} llama a {v}.|Primero revisa el {w}.|Le {w} dans {path} est vide.|La classe {W} appelle {v}.
{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs}|{zs} {W}|{zs} {path} {zs}|{W} {zs}|{zs} {n}|{zn}：{zs}|这个{w}的默认值是 {n}。|把超时时间改成 {n} 毫秒|单元测试全部通过|数据库连接失败，请检查配置|用户名和密码不能为空|任务已经完成|缓存命中率下降到 {n2}|函数返回空值时会报错|部署到生产环境之前先备份|请等待 {n} 秒|索引|配置|登录失败|查看日志|重构代码|更新文档|添加测试|第 {n} 行|需要管理员权限，由系统处理。|性能提升|内存不足|合并请求|任何人都可以访问|文件|高可用|和平台对接|常见问题|马上重启|于是超时|成功|方法名|包名|程序|时间|金额|计数器|密钥是 {hex} 不要泄露|向上取整|使用方法：{w}|和线程池一样
id,full_name,mail,tel|name;street;city|first_name last_name|Best,|Regards,|Cheers|Thanks!|BEGIN {U}|END {U}|Step {n1}: {U} the {w}|Fig. {n1}. {T} by {T}|Section {n1}.{n1} {T}|Note: {O} {o} {w}s.|{w}: {n}|- {w}|  {w}: {W}|TODO: {v} {w}"""
TEXTS, DECOYS = ([t.replace("⏎", "\n") for t in group.replace("\n", "|").split("|") if t] for group in (_ITEMS, _PLAIN))


class Maker:
    """Invents items and rows from one seeded generator."""

    def __init__(self, seed: int, given: Sequence[str], words: Sequence[str], wordy: Sequence[str] = ("Mark",)):
        """``words`` are ordinary words, ``wordy`` given names that are ordinary words too."""
        self.r = random.Random(seed)
        self.words, self.wordy = words, wordy
        self.given = [*GIVEN, *given]

    def _num(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def _syllables(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_CODA) for _ in range(n))

    def family(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.3:
            return r.choice(FAMILY)
        if x < 0.8:
            return (self._syllables(r.choice((1, 1, 2))) + r.choice(_END)).capitalize()
        if x < 0.87:
            return r.choice(("O'", "Mc", "Mac", "D'")) + self._syllables(1).capitalize() + r.choice(_END)
        return (r.choice(self.words) + r.choice(_END)).capitalize() if x < 0.98 else self._title()

    def first(self) -> str:
        return self._syllables(2).capitalize() + self.r.choice(("", "a", "o", "n")) if self.r.random() < 0.08 else self.r.choice(self.given)

    def person(self) -> str:
        r = self.r
        if r.random() < 0.18:
            return r.choice(_SURNAMES) + "".join(r.choice(_CJK_GIVEN) for _ in range(r.choice((1, 1, 2, 2))))
        g, s, x = self.first(), self.family(), r.random()
        if x < 0.10:
            s += "-" + self.family()
        elif x < 0.22:
            s += " " + self.family()
        elif x < 0.30:
            s = r.choice(("van ", "von ", "de ", "da ", "del ", "bin ", "de la ", "van der ")) + s
        y = r.random()
        if y < 0.11:
            return f"{g[0]}. {s}"
        if y < 0.14:
            return f"{g[0]}. {r.choice('ABCDEFGHJKLMNPRSTW')}. {s}"
        if y < 0.23:
            return f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}. {s}"
        if y < 0.33:
            return f"{s[0].upper() + s[1:]}, {g}"
        if y < 0.36:
            return f"{g} {self.first()} {s}"
        if y < 0.41:
            return f"{g} {s}".upper()
        return f"{g} {s}"

    def email(self) -> str:
        r = self.r
        g, s, w = r.choice(self.given), self.family(), r.choice(self.words)
        user = r.choice((f"{g}.{s}", f"{g}.{s}", f"{g[0]}{s}", f"{g}{self._num(2)}", f"{s}{self._num(r.choice((2, 4)))}", f"{w}-{r.choice(self.words)}", f"{g}+{w}", f"{g}_{s}", f"{g}_{r.choice('abcdest')}", w, f"{w}.{r.choice(self.words)}"))
        user = "".join(c for c in user if c.isascii() and (c.isalnum() or c in "._+-")) or "x"
        user = user if r.random() < 0.2 else user.lower()
        site = "".join(c for c in r.choice((self.family(), self._syllables(2), w + r.choice(self.words), w)) if c.isascii() and c.isalnum()).lower() or "site"
        host = r.choice(("", "", "", "mail.", "corp.", "eu.")) + site + r.choice(("", "", "-" + r.choice(self.words))) + r.choice(".com .org .net .io .example .test .invalid .co.uk .de .fr .es .cn .co.example .com.br .edu".split())
        host = host if r.random() < 0.85 else host.title()
        x = r.random()
        if x < 0.16:
            at, dot = r.choice((" [at] ", "[at]", " (at) ", "(at)", " AT ", " {at} ", "[arroba]", "(ät)")), r.choice((" [dot] ", "[dot]", " (dot) ", "(dot)", " DOT ", "."))
            return user.replace(".", dot if r.random() < 0.3 and dot != " DOT " else ".") + at + host.replace(".", dot)
        if x < 0.20:
            return f"{user} at {host.lower().replace('.', ' dot ')}"
        return f"{user}@{host}"

    def phone(self) -> str:
        r, n = self.r, self._num
        a, d = str(r.randint(201, 989)), lambda: str(r.randint(2, 9))
        sep = r.choice((" ", "-", "."))
        return r.choice((
            lambda: f"+1{sep}{a}{sep}{n(3)}{sep}{n(4)}", lambda: f"{a}{sep}{n(3)}{sep}{n(4)}", lambda: f"({a}) {n(3)}-{n(4)}", lambda: f"+1{a}{n(7)}", lambda: f"1-{a}-{n(3)}-{n(4)}", lambda: f"+1 ({a}) {n(3)}-{n(4)}",
            lambda: f"+44 7{n(3)} {n(6)}", lambda: f"07{n(3)} {n(6)}", lambda: f"0{d()}{n(2)} {n(3)} {n(4)}", lambda: f"(0{d()}{n(1)}) {n(4)} {n(4)}", lambda: f"0{d()}{n(1)} {n(4)} {n(4)}", lambda: f"+44 {d()}{n(1)} {n(4)} {n(4)}", lambda: f"0044 {d()}{n(1)} {n(4)} {n(4)}", lambda: f"+44{n(10)}",
            lambda: f"+49 {d()}{n(1)} {n(6)}", lambda: f"+49 {d()}{n(2)} {n(7)}", lambda: f"+49 {d()}{n(1)} {n(5)} {n(3)}", lambda: f"0{d()}{n(2)}/{n(7)}", lambda: f"0{d()}{n(2)}-{n(6)}", lambda: f"0{d()}{n(1)} {n(8)}", lambda: f"+49-{d()}{n(2)}-{n(7)}", lambda: f"0049 {d()}{n(2)} {n(7)}", lambda: f"0{d()}{n(2)}/{n(8)}",
            lambda: f"+33 {d()} {n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"0{d()}{sep}{n(2)}{sep}{n(2)}{sep}{n(2)}{sep}{n(2)}", lambda: f"+34 {d()}{n(2)} {n(3)} {n(3)}", lambda: f"{d()}{n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"+39 3{n(2)} {n(3)} {n(4)}", lambda: f"+48 {n(3)} {n(3)} {n(3)}", lambda: f"+31 6 {n(8)}",
            lambda: f"+91 {d()}{n(4)} {n(5)}", lambda: f"+91-{d()}{n(9)}", lambda: f"+55 {n(2)} 9{n(4)}-{n(4)}", lambda: f"+81 {d()}0-{n(4)}-{n(4)}", lambda: f"+61 4{n(2)} {n(3)} {n(3)}", lambda: f"+46 70 {n(3)} {n(2)} {n(2)}", lambda: f"+7 9{n(2)} {n(3)}-{n(2)}-{n(2)}",
            lambda: f"1{r.randint(3, 9)}{n(9)}", lambda: f"1{r.randint(3, 9)}{n(1)}{r.choice(' -')}{n(4)}{r.choice(' -')}{n(4)}", lambda: f"+86 1{r.randint(3, 9)}{n(1)} {n(4)} {n(4)}", lambda: f"+86 1{r.randint(3, 9)}{n(9)}", lambda: f"0{d()}{n(2)}-{n(8)}",
        ))()

    def idnum(self) -> str:
        r, n = self.r, self._num
        day = f"{r.randint(1, 12):02}{r.randint(1, 28):02}"
        born = f"{r.randint(1940, 2009)}{day}"
        u = lambda k=1: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(k))
        return r.choice((
            lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"9{n(2)} {n(2)} {n(4)}", lambda: f"{n(6)}{born}{n(3)}{r.choice('0123456789X')}", lambda: f"{n(6)}{born}{n(3)}{r.choice('0123456789X')}", lambda: f"{n(3)}.{n(3)}.{n(3)}-{n(2)}", lambda: f"{n(2)} {n(3)} {n(3)} {n(3)}", lambda: n(11),
            lambda: f"{n(8)}{u()}", lambda: f"{n(8)}-{u()}", lambda: f"{r.choice('XYZ')}{n(7)}{u()}", lambda: f"{r.choice('XYZ')}-{n(7)}-{u()}", lambda: f"{u(2)}{n(6)}{u()}", lambda: f"{u(2)} {n(2)} {n(2)} {n(2)} {u()}", lambda: f"{n(4)} {n(4)} {n(4)}", lambda: f"{u(r.choice((1, 2)))}{n(r.choice((7, 8)))}", lambda: f"{u(2)}{n(7)}",
            lambda: f"{u(5)}{n(4)}{u()}", lambda: f"{u(6)}{n(2)}{u()}{n(2)}{u()}{n(3)}{u()}", lambda: f"{n(2)}{day}-{r.choice('1234')}{n(6)}", lambda: f"{born}-{n(4)}", lambda: f"{r.choice('12')} {n(2)} {n(2)} {n(2)} {n(3)} {n(3)} {n(2)}", lambda: n(9), lambda: f"{n(3)} {n(3)} {n(3)}", lambda: f"{n(2)}.{n(2)}.{n(2)}-{n(3)}.{n(2)}",
        ))()

    def address(self) -> str:
        r, n = self.r, self._num
        town = r.choice((r.choice(_TOWN), self.family().split("'")[-1].capitalize(), r.choice(("San ", "Bad ", "New ", "Saint ", "Los ", "Port ")) + r.choice(_TOWN)))
        way = r.choice((r.choice(_STREET), r.choice(_STREET), self._syllables(1).capitalize() + r.choice(_END), f"{r.choice(_STREET)} {r.choice(_STREET)}"))
        kind = r.choice("Street St St. Avenue Ave Road Rd Lane Drive Dr Boulevard Blvd Court Way Close Mews Crescent Terrace Place".split())
        x = r.randrange(9)
        if x == 0:
            unit = r.choice(("", "", f", Apt {n(2)}{r.choice('ABC')}", f", Suite {n(3)}", f", Unit {n(1)}"))
            return f"{r.randint(1, 9999)} {r.choice(('', '', '', 'N ', 'W ', 'SE '))}{way} {kind}{unit}, {town}, {r.choice(_STATE)} {n(5)}"
        if x == 1:
            return f"{r.choice(('', '', '', f'Flat {n(1)}, '))}{r.randint(1, 199)} {way} {kind}, {town} {r.choice(('N', 'SW', 'EC', 'LS', 'M', 'BS', 'OX', 'CB', 'G', 'NE'))}{r.randint(1, 29)} {n(1)}{r.choice('ABDEFGH')}{r.choice('HJLNPQRT')}"
        if x == 2:
            street = r.choice((r.choice(_STREET_DE), self._syllables(1).capitalize() + r.choice(("er", "en", "el", "berg", "hof"))))
            return f"{street}{r.choice(('str.', 'straße', 'gasse', 'weg', 'platz', 'allee'))} {r.randint(1, 130)}{r.choice(('', '', 'a', ' b'))}, {n(5)} {town}"
        if x == 3:
            street = r.choice((self.family(), r.choice(_TOWN), "de " + r.choice(_TOWN), "de la " + r.choice(_STREET)))
            return f"{r.choice(('Calle', 'Calle', 'Avenida', 'Plaza', 'Paseo', 'C/'))} {street} {r.randint(1, 90)}{r.choice((f', {r.randint(1, 8)}º', f', {r.randint(1, 8)}º {r.choice("ABCD")}', '', ''))}, {n(5)} {town}"
        if x == 4:
            return f"{r.randint(1, 99)}{r.choice(('', '', ' bis', ' ter'))} {r.choice(('rue', 'rue des', 'rue de', 'avenue de', 'rue du', 'boulevard', 'place de la'))} {self.family().split(chr(39))[-1].capitalize()}{r.choice(('', 's'))}, {n(5)} {town}"
        if x == 5:
            return f"{r.choice(('Via', 'Viale', 'Piazza', 'Corso', 'ul.'))} {r.choice((r.choice(_TOWN), self.family()))} {r.randint(1, 90)}, {r.choice((n(5), n(2) + '-' + n(3)))} {town}"
        c = r.choice((r.choice(_CJK_TOWN), "".join(r.choice("安海江山宁阳林河溪州南北清金新") for _ in range(2))))
        road = r.choice((r.choice(_CJK_STREET), "".join(r.choice("安海江山云阳林河溪松南北清金新柳") for _ in range(2))))
        return f"{r.choice(('', '', f'{r.choice(_CJK_TOWN)}省'))}{c}市{r.choice(('', r.choice(_CJK_TOWN) + '区', r.choice('东西南北新') + r.choice('城山湖江') + '区'))}{road}{r.choice(('路', '路', '街', '大道'))}{r.randint(1, 480)}号{r.choice(('', '', f'{r.randint(1, 19)}栋', f'{r.randint(1, 5)}单元', f'{r.randint(1, 19)}号楼'))}{r.choice(('', f'{n(3)}室', f'{n(4)}室'))}"

    def _title(self) -> str:
        return self.r.choice(self.words).capitalize()

    def _chinese(self) -> str:
        """A made sentence of one to three clauses of nouns, verbs and adverbs."""
        r, n, v, a = self.r, lambda: self.r.choice(_CJK_NOUN), lambda: self.r.choice(_CJK_VERB), lambda: self.r.choice(_CJK_ADVERB)
        clauses = (
            lambda: n() + a() + v(), lambda: a() + v() + n(), lambda: v() + n() + "的" + n(), lambda: n() + "和" + n() + a() + v(), lambda: r.choice("由给让被向跟找问是替与同见") + n() + v(), lambda: n() + v(), lambda: v() + v(), lambda: a() + v(),
            lambda: n() + r.choice("里上中下后前") + n() + v(), lambda: v() + r.choice("时后前") + v() + n(), lambda: n() + r.choice("是叫") + n(), lambda: a() + v() + r.choice("了过完"), lambda: n() + v() + self._num(2) + r.choice("次条行"),
        )
        parts = [r.choice(clauses)() for _ in range(r.choice((1, 1, 2, 3)))]
        return r.choice(("，", "，", "。", " ")).join(parts) + r.choice(("", "。", "？"))

    def _filler(self, name: str) -> str:
        r, n = self.r, self._num
        match name:
            case "w" | "o" | "v":
                return r.choice(self.words)
            case "W":
                return self._title() + self._title()
            case "O":
                return self._title()
            case "T":
                return " ".join(self._title() if r.random() < 0.6 else r.choice(_INTERFACE) for _ in range(r.choice((2, 2, 3))))
            case "U":
                return r.choice(_INTERFACE)
            case "C":
                return r.choice(_COMPUTING)
            case "UU":
                return r.choice(_INTERFACE).upper()
            case "CC":
                return r.choice(_COMPUTING).upper()
            case "P":
                return r.choice(_PLACES)
            case "G":
                return r.choice(self.wordy)
            case "n":
                return str(r.randint(2, 9999))
            case "n2":
                return str(r.randint(10, 99))
            case "n5":
                return str(r.randint(10000, 65000))
            case "n0" | "n1" | "n3" | "n4" | "n8" | "n6":
                return n(max(1, int(name[1])))
            case "long":
                return str(r.randint(10**8, 10**9 - 1))
            case "ts":
                return str(r.randint(15 * 10**8, 18 * 10**8))
            case "hex":
                return "".join(r.choice("0123456789abcdef") for _ in range(8))
            case "pw":
                return r.choice((f"{r.choice(self.words)}-{r.choice(self.words)}-{n(3)}", "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHJK23456789-_.") for _ in range(r.randint(8, 20))), f"{self._title()}_{n(4)}"))
            case "site":
                return f"{self._syllables(2)}{r.choice(('', '-' + r.choice(self.words)))}{r.choice(('.com', '.example', '.internal', '.org', '.test'))}" if r.random() < 0.7 else r.choice(_HOSTS)
            case "path":
                return f"{r.choice(self.words)}/{r.choice(self.words)}.{r.choice(('py', 'go', 'ts', 'java'))}"
            case "id":
                return r.choice(_ID_WORDS)
            case "role":
                return r.choice(_ROLE)
            case "year":
                return str(r.randint(1950, 2025))
            case "ver":
                return f"{r.randint(0, 20)}.{r.randint(0, 40)}.{r.randint(0, 9)}"
            case "A" | "AA":
                return "".join(r.choice("ABCDEFGHKLMNPRST") for _ in name)
            case "zs":
                return self._chinese()
            case "zn":
                return r.choice(_CJK_NOUN)
            case "zv":
                return r.choice(_CJK_VERB)
            case "za":
                return r.choice(_CJK_ADVERB)
            case "dn":
                return r.choice(_GERMAN_NOUN)
        raise KeyError(name)

    def fill(self, template: str) -> tuple[str, list[tuple[int, int, int]]]:
        """(text, [(kind, begin, end)])"""
        text, marks, at = "", [], 0
        while at < len(template):
            end = template.find("}", at)
            name = template[at + 1 : end] if template[at] == "{" and end > at else ""
            if name in KINDS:
                item = getattr(self, name)()
                marks.append((KINDS.index(name), len(text), len(text) + len(item)))
                text += item
            elif name.isalnum():
                text += self._filler(name)
            else:
                text += template[at]
                at += 1
                continue
            at = end + 1
        return text, marks

    def table(self) -> tuple[str, list[tuple[int, int, int]]]:
        """Rows of items with a separator, with or without a heading."""
        r = self.r
        kinds = [k for k in KINDS if r.random() < 0.6] or ["email"]
        r.shuffle(kinds)
        sep, head = r.choice((",", ";", " | ", "\t")), r.random() < 0.8
        text, marks = sep.join(["id", *(r.choice(_KEYS[k]) for k in kinds)]) if head else "", []
        for _ in range(r.randint(1, 3)):
            text += ("\n" if text else "") + str(r.randint(1, 9999))
            for k in kinds:
                item = getattr(self, k)()
                quote = '"' if sep == "," and "," in item else ""
                text += sep + quote
                marks.append((KINDS.index(k), len(text), len(text) + len(item)))
                text += item + quote
        return text, marks

    def record(self) -> tuple[str, list[tuple[int, int, int]]]:
        """Members of an object, on one line or on several, as JSON, YAML or assignments."""
        r = self.r
        kinds = [k for k in KINDS if r.random() < 0.5] or ["person"]
        form = r.randrange(3)
        text, marks = ("{" if form == 0 else ""), []
        join = r.choice((", ", ",\n  ")) if form == 0 else "\n"
        for i, k in enumerate(kinds):
            key = r.choice(_KEYS[k])
            text += (join if i else "") + (f'"{key}": "' if form == 0 else f"{r.choice(('', '  '))}{key}: " if form == 1 else f'{key} = "')
            item = getattr(self, k)()
            marks.append((KINDS.index(k), len(text), len(text) + len(item)))
            text += item + ('"' if form != 1 else "")
        return text + ("}" if form == 0 else ""), marks

    def row(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A few lines in one text, items and decoys mixed, now and then on one line as chat texts are."""
        r, text, marks = self.r, "", []
        for _ in range(r.randint(1, 5)):
            x = r.random()
            part, here = self.table() if x < 0.10 else self.record() if x < 0.18 else self.fill(r.choice(TEXTS) if x < 0.5 else r.choice(DECOYS))
            if text:
                text += r.choice(("\n", "\n", "\n", " ", ". "))
            marks += [(k, b + len(text), e + len(text)) for k, b, e in here]
            text += part
        if "\n" not in text and '"' not in text and r.random() < 0.3:  # a text within JSON
            head = '[{"text": "' + r.choice(self.words) + '"}, {"text": "'
            marks = [(k, b + len(head), e + len(head)) for k, b, e in marks]
            text = head + text + '"}]'
        return text, marks
